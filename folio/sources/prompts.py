"""Prompt catalogue (S9) and rendering (S10) as tables.

Prompt files are few and small, so the driver reads them into a table once; listing, tag
filters and rendering are then DataFrame expressions that join to requests like any table.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import has_all_tags
from ..schemas import PROMPT


def read_prompt_files(spark: SparkSession, prompts_dir: str, doc: str) -> DataFrame:
    """Every ``v*.yaml`` of a document kind, sorted; missing keys default to empty.

    The files are read by Spark, so the folder may be in any store; a missing folder is an error.
    Prompt versions are a handful of small files: their texts come to the driver.
    """
    import yaml  # prompt files are YAML

    files = spark.read.option("pathGlobFilter", "v*.yaml").text(prompts_dir, wholetext=True)
    files = files.select(F.col("_metadata.file_name").alias("name"), "value").orderBy("name").collect()
    rows = []
    for name, text in files:
        data = yaml.safe_load(text) or {}
        rows.append(
            (
                doc,
                os.path.splitext(name)[0],
                data.get("description", ""),
                list(data.get("template_vars", []) or []),
                list(data.get("tags", []) or []),
                data.get("prompt"),
            )
        )
    return spark.createDataFrame(rows, PROMPT)


def catalog_from_texts(texts: DataFrame, id_col: str = "item_id", text_col: str = "text", doc: str = "bench") -> DataFrame:
    """A prompt table derived from a text table: one version per item, tags and variables by rule."""
    n = F.col(id_col)
    tags = (
        F.when(n % 3 == 0, F.array(F.lit("ignore_noise")))
        .when(n % 3 == 1, F.array(F.lit("ignore_noise"), F.lit("fr")))
        .otherwise(F.array().cast("array<string>"))
    )
    tvars = (
        F.when(n % 4 == 0, F.array(F.lit("case")))
        .when(n % 4 == 1, F.array(F.lit("case"), F.lit("place")))
        .otherwise(F.array().cast("array<string>"))
    )
    prompt = (
        F.when(n % 4 == 0, F.concat(F.col(text_col), F.lit(" Case: {case}. Keep {braces} as they are.")))
        .when(n % 4 == 1, F.concat(F.lit("{place}: "), F.col(text_col), F.lit(" Case: {case}.")))
        .otherwise(F.concat(F.col(text_col), F.lit(' Output {"a": ""}.')))
    )
    return texts.select(
        F.lit(doc).alias("doc"),
        F.concat(F.lit("v"), n.cast("string")).alias("version"),
        F.substring(F.col(text_col), 1, 40).alias("description"),
        tvars.alias("template_vars"),
        tags.alias("tags"),
        prompt.alias("prompt"),
    )


def list_prompts(catalog: DataFrame, tags: Sequence[str] | None = None) -> DataFrame:
    """Versions that carry ALL the given tags (no tags: all), sorted by version."""
    out = catalog.where(has_all_tags(F.col("tags"), tags)) if tags else catalog
    return out.select("doc", "version", "description", "tags", "template_vars").orderBy("doc", "version")


def render(catalog: DataFrame, vars_col: str) -> DataFrame:
    """Fill the named ``{var}`` tokens from a ``map<string,string>`` column.

    Only the declared variables are replaced (other braces stay), all in one pass over the
    template: a value that itself holds a token is not filled again. When the template declares
    none, the text is returned as is. ``missing_vars`` lists declared variables without a
    value; ``rendered`` is NULL then (a renderer that raises would stop the whole job).
    """
    tv = F.coalesce(F.col("template_vars"), F.array().cast("array<string>"))
    values = F.col(vars_col)
    missing = F.array_except(tv, F.coalesce(F.map_keys(values), F.array().cast("array<string>")))

    def fill(piece: Column, i: Column) -> Column:
        """A piece of the template after an opening brace: a token and the rest, or plain text."""
        name = F.substring_index(piece, "}", 1)
        token = piece.contains("}") & F.array_contains(tv, name)
        rest = F.substr(piece, F.char_length(name) + 2)
        filled = F.concat(F.coalesce(F.try_element_at(values, name), F.lit("")), rest)
        return F.when(i == 0, piece).when(token, filled).otherwise(F.concat(F.lit("{"), piece))

    filled = F.array_join(F.transform(F.split(F.col("prompt"), r"\{", -1), fill), "")
    rendered = F.when(F.size(tv) == 0, F.col("prompt")).when(F.size(missing) == 0, filled)
    return catalog.withColumns({"rendered": rendered, "missing_vars": missing})


def get_prompt(catalog: DataFrame, doc: str, version: str) -> DataFrame:
    """One prompt version of a document kind; an unknown one is an error that lists the versions."""
    found = catalog.where((F.col("doc") == doc) & (F.col("version") == version))
    if found.isEmpty():
        known = [r["version"] for r in catalog.where(F.col("doc") == doc).select("version").orderBy("version").collect()]
        raise LookupError(f"no prompt {version!r} for {doc!r}; available: {', '.join(known) or 'none'}")
    return found
