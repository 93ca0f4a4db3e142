"""Schemas of the data model (manifest, truth, prompts, assets, results, layout) and settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# M1: dataset manifest. Explicit schema, never inferred.
MANIFEST = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in ("id", "in", "out", "tags", "notes")]
)

# M3: prompt record.
PROMPT = T.StructType(
    [
        T.StructField("doc", T.StringType(), False),
        T.StructField("version", T.StringType(), False),
        T.StructField("description", T.StringType(), True),
        T.StructField("template_vars", T.ArrayType(T.StringType()), True),
        T.StructField("tags", T.ArrayType(T.StringType()), True),
        T.StructField("prompt", T.StringType(), True),
    ]
)

# M8: one experiment result row, as written by a run (timestamp is naive local time).
RESULT_ROW = T.StructType(
    [
        T.StructField("id", T.StringType(), True),
        T.StructField("doc", T.StringType(), True),
        T.StructField("model", T.StringType(), True),
        T.StructField("tags", T.StringType(), True),
        T.StructField("notes", T.StringType(), True),
        T.StructField("timestamp", T.StringType(), True),
        T.StructField("execution_time", T.DoubleType(), True),
        T.StructField("correct_fields", T.DoubleType(), True),
        T.StructField("correct_fields_reason", T.StringType(), True),
        T.StructField("format_compliance", T.StringType(), True),
        T.StructField("format_compliance_reason", T.StringType(), True),
        T.StructField("expected", T.StringType(), True),
        T.StructField("generated", T.StringType(), True),
    ]
)

# Display and detail columns of the results table, in display order.
DISPLAY_COLS = [
    "id",
    "doc",
    "model",
    "prompt_version",
    "tags",
    "notes",
    "timestamp",
    "execution_time",
    "correct_fields",
    "format_compliance",
]
DETAIL_COLS = ["correct_fields_reason", "format_compliance_reason", "expected", "generated"]

# Layout tree pages -> blocks -> lines -> words.
WORD = T.StructType([T.StructField("value", T.StringType(), True)])
LINE = T.StructType([T.StructField("words", T.ArrayType(WORD), True)])
BLOCK = T.StructType([T.StructField("lines", T.ArrayType(LINE), True)])
PAGE = T.StructType([T.StructField("blocks", T.ArrayType(BLOCK), True)])
LAYOUT = T.ArrayType(PAGE)

# Media types accepted by the chat API, keyed by lower-case suffix.
API_MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".webp": "image/webp",
}

# Formats accepted by image validation (decoder names, lower case).
VALIDATION_FORMATS = ("jpg", "jpeg", "png", "bmp", "tiff")


@dataclass(frozen=True)
class Settings:
    """Run settings. Immutable; passed to operators, shipped to workers by closure."""

    model_id: str = "ocr-model"
    text_model_id: str = "text-model"
    device: str = "cpu"
    max_new_tokens: int = 4096
    do_sample: bool = False
    max_image_size_mb: int = 10
    supported_formats: tuple[str, ...] = VALIDATION_FORMATS
    api_max_tokens: int = 1024
    extra: dict = field(default_factory=dict, compare=False, hash=False)


# Field-format rules of the identity-card document (doc, field, pattern, empty allowed).
# The id pattern widens the prompt's "1-2 letters + 5-6 digits" to 5-8 digits, since both
# ground-truth ids have 7 and 8 digits.
FIELD_RULES = [
    ("cin", "prenom", r"^[^0-9]+$", True),
    ("cin", "nom", r"^[^0-9]+$", True),
    ("cin", "id_document_recto", r"^[A-Z]{1,2}[0-9]{5,8}$", True),
    ("cin", "date_naissance", r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$", True),
    ("cin", "lieu_naissance", r"^.+$", True),
    ("cin", "initiales", r"^[A-Z]{1,3}$", True),
    ("cin", "date_expiration", r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$", True),
    ("cin", "nationalite", r"^Marocaine$", False),
]
