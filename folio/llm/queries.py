"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    attention_lm,
    chat,
    collocations,
    dual_tree,
    fertility,
    fingerprint,
    licenses,
    mixing,
    neardup,
    packing,
    site_templates,
    token_counts,
    toxicity,
)
from ._common import load, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


#: A text that consists of the marks of a common template.
MARKS = "</s>[INST] ok [/INST]"


@query
def op1_chat_format(spark, sf):
    """Every conversation as one formatted text, described by what is read back from it."""
    rows = load(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = [(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)]
    rows = rows.unionByName(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    messages = stored(chat.chain(rows, "conv_id", "turn", "role", "text"), "messages")
    formatted = chat.format_paths(chat.reply_paths(messages, best=1), messages)
    read = chat.read_back(F.col("formatted"), F.col("mask"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return formatted.select(F.col("tree").alias("conv_id"), "formatted", *[c.alias(k) for k, c in read.items()]).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op2_fingerprints(spark, sf):
    """Digests of every document and of its edited text."""
    return fingerprint.fingerprints(load(spark, sf, "documents"))


@query
def op3_lm_scoring(spark, sf):
    """Attention model's and smoothed unigram's log-probability of every document."""
    return attention_lm.lm_scores(load(spark, sf, "documents"))


@query
def op4_packing(spark, sf):
    """Pieces of all documents packed into windows of 2048 tokens."""
    pieces = packing.pack(load(spark, sf, "documents"))
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


@query
def op5_quality_rules(spark, sf):
    """Word statistics and fertility verdict of every document."""
    return fertility.measures(load(spark, sf, "documents"))


@query
def op6_minhash_near_dedup(spark, sf):
    """Near-duplicate class of every document."""
    return neardup.classes(load(spark, sf, "documents")).drop("node", "root")


@query
def op7_mixing(spark, sf):
    """Words that the mix takes of every document."""
    rows = mixing.repetitions(load(spark, sf, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return rows.select("row.doc_id", "size", "source_size", "target", taken)


@query
def op8_license_scan(spark, sf):
    """Licence phrases and labels of every document."""
    return licenses.scan(load(spark, sf, "documents"))


@query
def op9_toxicity(spark, sf):
    """Toxicity score of every document, learned from the labelled rows of two of three folds."""
    docs = load(spark, sf, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, load(spark, sf, "labels")))


@query
def op10_token_counts(spark, sf):
    """Bytes and sentence-piece tokens of every document."""
    return token_counts.token_counts(load(spark, sf, "documents"))


@query
def op11_collocations(spark, sf):
    """The strongest phrases of two and three words of every language."""
    return collocations.phrases(load(spark, sf, "documents"))


@query
def op12_ranked_search(spark, sf):
    """The 50 best documents of every benchmark item."""
    return dual_tree.search(load(spark, sf, "benchmark"), load(spark, sf, "documents"))


@query
def op13_html_extraction(spark, sf):
    """The main text of every page."""
    pages = site_templates.main_text(load(spark, sf, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


# ---------------------------------------------------------------- SQL

ORACLES["op1_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *,
    regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g') AS role_out,
    regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g') AS text_out
  FROM rows
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(length('<s></s>') + sum(length('<|turn|><|says|><|end|>') + length(role_out) + length(text_out)) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def _license_sql() -> str:
    """Every word of a template in a text gives a place; all places are compared with the whole template."""
    wordings = ", ".join(
        f"({i}, '{t.label}', {t.base}, {t.key_at}, {t.key_at + len(t.key.split())}, {j}, '{w}')"
        for i, t in enumerate(licenses.TEMPLATES)
        for j, w in enumerate(t.words)
    )
    return (
        r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), words AS (
  SELECT r, pos, lower(ws[pos + 1]) AS word FROM (SELECT r, ws, unnest(range(len(ws))) AS pos FROM docs)
), t(i, label, base, key_from, key_to, j, word) AS (VALUES """
        + wordings
        + f"""
), hits AS (
  SELECT * FROM words WHERE word IN (SELECT word FROM t)
), df AS (
  SELECT word, count(DISTINCT r) AS df FROM hits GROUP BY word
), top AS (
  SELECT r, word FROM (SELECT DISTINCT r, word FROM hits) JOIN df USING (word)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY df, word) <= {licenses.TOP_WORDS}
), places AS (
  SELECT h.r, t.i, h.pos - t.j AS start, bool_or(top.word IS NOT NULL) AS by_top
  FROM hits h JOIN t USING (word) LEFT JOIN top ON top.r = h.r AND top.word = h.word GROUP BY 1, 2, 3
), matched AS (
  SELECT p.r, p.i, p.start, any_value(t.label) AS label, any_value(t.base) AS base, any_value(p.by_top) AS by_top,
    count(w.word) / CAST(count(*) AS DOUBLE) AS coverage,
    bool_and(w.word IS NOT NULL OR t.j < t.key_from OR t.j >= t.key_to) AS key_found
  FROM places p JOIN t ON t.i = p.i LEFT JOIN hits w ON w.r = p.r AND w.pos = p.start + t.j AND w.word = t.word
  GROUP BY p.r, p.i, p.start
), found AS (
  SELECT r, max(coverage) FILTER (by_top OR key_found) AS score,
    count(*) FILTER (base AND coverage = 1) AS n_base,
    min(start) FILTER (base AND coverage = 1) AS first_word,
    max(start) FILTER (base AND coverage = 1) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND coverage = 1) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label)
      FILTER (CASE WHEN base THEN coverage = 1 ELSE coverage >= {licenses.MIN_COVERAGE} AND key_found END) AS labels
  FROM matched GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN found USING (r)
"""
    )


ORACLES["op8_license_scan"] = _license_sql()


def _lowered(column: str) -> str:
    """ASCII letters in lower case, the others as they are."""
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ORACLES["op11_collocations"] = (
    r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, regexp_extract_all(unnest(regexp_split_to_array("""
    + _lowered("text")
    + r""", '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM documents)
), spots AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(words[pos:pos + k - 1], ' ') AS phrase, words[pos] AS head, words[pos + k - 1] AS tail,
    array_to_string(words[pos:pos + k - 2], ' ') AS most, array_to_string(words[pos + 1:pos + k - 1], ' ') AS rest
  FROM spots, (VALUES (1), (2), (3)) t(k) WHERE pos + k - 1 <= len(words)
), f AS (
  SELECT lang, k, phrase, any_value(head) AS head, any_value(tail) AS tail, any_value(most) AS most, any_value(rest) AS rest,
    count(*) AS f
  FROM grams GROUP BY lang, k, phrase
), sizes AS (
  SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.most, c.rest, c.f AS a, 1 AS cut, x.f AS l, y.f AS r FROM f c
  JOIN f x ON x.lang = c.lang AND x.k = 1 AND x.phrase = c.head
  JOIN f y ON y.lang = c.lang AND y.k = c.k - 1 AND y.phrase = c.rest
  WHERE c.k > 1 AND c.f >= 10
  UNION ALL
  SELECT c.lang, c.phrase, c.k, c.most, c.rest, c.f, 2, x.f, y.f FROM f c
  JOIN f x ON x.lang = c.lang AND x.k = 2 AND x.phrase = c.most
  JOIN f y ON y.lang = c.lang AND y.k = 1 AND y.phrase = c.tail
  WHERE c.k = 3 AND c.f >= 10
), scored AS (
  SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts
), candidates AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, part, max(a) AS a FROM (
    SELECT lang, most AS part, a FROM candidates WHERE k = 3 UNION ALL SELECT lang, rest, a FROM candidates WHERE k = 3)
  GROUP BY lang, part
)
SELECT c.lang, row_number() OVER w AS rank, c.phrase, c.a, c.l, c.r, CAST(n AS BIGINT) AS n, c.score
FROM candidates c JOIN sizes USING (lang) LEFT JOIN longer o ON o.lang = c.lang AND o.part = c.phrase AND c.k = 2
WHERE o.a IS NULL OR 100 * o.a < 50 * c.a
WINDOW w AS (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase)
QUALIFY row_number() OVER w <= 2000
"""
)

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
ORACLES["op12_ranked_search"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_lowered("text")}, {_TERM}) AS ts FROM documents
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS length FROM docs WHERE len(ts) > 0
), tf AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ts) AS term FROM docs) GROUP BY d, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, totals GROUP BY term, n_docs
), items AS (
  SELECT DISTINCT i, item_id, unnest(ts) AS term FROM (
    SELECT row_number() OVER () AS i, item_id, regexp_extract_all({_lowered("text")}, {_TERM}) AS ts FROM benchmark)
), scores AS (
  SELECT i, item_id, d, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * CAST(len(ts) AS BIGINT) * n_docs) // length)))) AS BIGINT) AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN docs USING (d), totals
  GROUP BY i, item_id, d, doc_id
)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW w AS (PARTITION BY i ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER w <= 50
"""
