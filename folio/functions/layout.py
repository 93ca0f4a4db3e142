"""Layout-tree column functions (higher-order functions: no explode, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col


def page_lines(page) -> Column:
    """Lines of one page: words joined by a space, blocks and lines kept in order."""
    return F.flatten(
        F.transform(
            page["blocks"],
            lambda b: F.transform(
                b["lines"], lambda ln: F.array_join(F.transform(ln["words"], lambda w: w["value"]), " ")
            ),
        )
    )


def page_text(page) -> Column:
    return F.array_join(page_lines(page), "\n")


def layout_to_text(pages) -> Column:
    """pages -> blocks -> lines -> words flattened to text: words by space, every line on its own line."""
    return F.array_join(F.flatten(F.transform(as_col(pages), page_lines)), "\n")


def items_to_text(items, field: str = "text") -> Column:
    """Text items of a converted document joined by newlines."""
    return F.array_join(F.transform(as_col(items), lambda t: t[field]), "\n")


def text_to_layout(text, lines_per_page: int = 20) -> Column:
    """Build a one-block-per-page layout tree from text (``lines_per_page`` lines per page).

    The split is referenced once per page; on a frame, split in its own projection and call
    ``lines_to_layout`` on that column so each text is split once (see ``ocr_pages``).
    """
    return lines_to_layout(F.split(as_col(text), "\n", -1), lines_per_page)


def lines_to_layout(lines, lines_per_page: int = 20) -> Column:
    """Build a one-block-per-page layout tree from an array of lines."""
    lines = as_col(lines)
    n_pages = F.floor((F.size(lines) - 1) / lines_per_page).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n_pages),
        lambda p: F.struct(
            F.array(
                F.struct(
                    F.transform(
                        F.slice(lines, p * lines_per_page + 1, F.lit(lines_per_page)),
                        lambda x: F.struct(
                            F.transform(F.split(x, " ", -1), lambda w: F.struct(w.alias("value"))).alias("words")
                        ),
                    ).alias("lines")
                )
            ).alias("blocks")
        ),
    )
