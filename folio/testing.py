"""Deterministic stand-ins for models: what tests and the queries over the test tables put in place of real backends.

Their answers follow from their inputs by simple rules, so that results can be checked against SQL.
"""

from __future__ import annotations

import base64
import json
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from .operators.inference import BaseBackend


class EchoTextBackend(BaseBackend):
    """Text model: echoes the prompt, then answers with its word count."""

    model_id = "echo-text"

    def _generate(self, prompt, settings):
        if prompt is None or prompt == "":
            raise ValueError("empty prompt")
        n = len(str(prompt).split())
        return f"{prompt}\n  answer: {n} words (max {settings.max_new_tokens})  "


class LayoutReaderBackend(BaseBackend):
    """OCR: reads a page given as layout JSON and returns its text, a line of words per line."""

    model_id = "layout-reader"

    def _generate(self, page_json, settings):
        read: list[str] = []

        def inside_out(part):  # words come before the line that holds them, lines in page order
            if "words" in part:
                read.append(" ".join(part["words"] or []))
            return part["value"] or "" if "value" in part else part

        json.loads(page_json, object_hook=inside_out)
        return "\n".join(read)


class ImageSizeBackend(BaseBackend):
    """OCR: "reads" a PNG by reporting its size from the header."""

    model_id = "image-size"

    def _generate(self, content, settings):
        b = bytes(content)
        if b[:8] != b"\x89PNG\r\n\x1a\n":
            raise ValueError("not a PNG image")
        w, h = struct.unpack(">II", b[16:24])
        return f"image {w}x{h}"


class KeywordJudgeBackend(BaseBackend):
    """Judge: the label of the first keyword found in the prompt."""

    model_id = "keyword-judge"

    def __init__(self, rules=(("I cannot read", "incorrect"), ("```", "Correct."), ("CASABLANCA", "maybe")),
                 default="correct"):
        super().__init__()
        self.rules = rules
        self.default = default

    def _generate(self, prompt, settings):
        for keyword, label in self.rules:
            if keyword in prompt:
                return label
        return self.default


class OutlineBackend(BaseBackend):
    """Summariser: a markdown outline of the bullet lines it is given."""

    model_id = "outline"

    def _generate(self, prompt, settings):
        bullets = [ln[2:] for ln in str(prompt).splitlines() if ln.startswith("- ")]
        return "# Summary\n" + "\n".join(f"## {b}" for b in bullets)


def card_text(values: dict[str, Column]) -> Column:
    """A document's printed text as ``label: value`` lines (the stand-in input for test clients)."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in values.items()])


# Reading behaviour of the test client per model name (fields it skips, date separator).
CARD_READERS = {
    "reader-exact": {"skip": (), "date_sep": "."},
    "reader-sloppy": {"skip": ("initiales",), "date_sep": "/"},
}
UNREADABLE = "I cannot read this image."
_ANSWER = json.JSONEncoder(ensure_ascii=False)


class CardReaderClient(BaseBackend):
    """Chat client: reads the ``label: value`` lines of the file block and
    answers with a JSON object, shaped by the requested model's reading behaviour. The answer is
    fenced as a markdown code block unless the prompt asks for no markdown. Blank input gives a
    refusal text."""

    model_id = "card-reader"

    def _generate(self, request_json, settings):
        req = json.loads(request_json)
        blocks = req["messages"][0]["content"]
        return self._answer(CARD_READERS[req["model"]], base64.b64decode(blocks[0]["source"]["data"] or ""), blocks[1]["text"] or "")

    def _answer(self, behaviour, content, prompt):
        data = content.decode("utf-8")
        if not data.strip():
            return UNREADABLE
        out = {}
        for line in data.split("\n"):
            label, _, value = line.partition(": ")
            if label in behaviour["skip"]:
                continue
            if label.startswith("date_"):
                value = value.replace(".", behaviour["date_sep"])
            out[label] = value
        text = _ANSWER.encode(out)
        return text if "no markdown" in prompt else f"```json\n{text}\n```"
