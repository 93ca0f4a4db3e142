"""Column functions: pure expressions that Catalyst can push, prune and code-generate."""

from .jsontext import looks_like_object, parse_object, parse_object_strict, pretty_json, raw_valid_json
from .layout import items_to_text, layout_to_text, lines_to_layout, page_text, text_to_layout
from .paths import block_type, file_name, media_type, resolve, stem, suffix
from .tags import has_all_tags, has_any_tag, parse_tags
from .text import (
    demote_headings,
    fence_strip,
    is_fenced,
    iso_seconds,
    iso_text,
    iso_utc_text,
    preview,
    py_strip,
    stamp_text,
    strip_echo,
    utc_wall_clock,
)

__all__ = [
    "block_type",
    "demote_headings",
    "fence_strip",
    "file_name",
    "has_all_tags",
    "has_any_tag",
    "is_fenced",
    "iso_seconds",
    "iso_text",
    "iso_utc_text",
    "items_to_text",
    "layout_to_text",
    "lines_to_layout",
    "looks_like_object",
    "media_type",
    "page_text",
    "parse_object",
    "parse_object_strict",
    "parse_tags",
    "preview",
    "pretty_json",
    "py_strip",
    "raw_valid_json",
    "resolve",
    "stem",
    "strip_echo",
    "stamp_text",
    "suffix",
    "text_to_layout",
    "utc_wall_clock",
]
