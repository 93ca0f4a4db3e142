"""Phrase collocations: adjacent pairs of frequency-ranked ids, counted in tiles, level by level.

One level turns a sequence of symbols into counts of adjacent symbols:

1. A chunk is up to ``CHUNK_BYTES`` of one language's texts, dictionary encoded: the chunk's own
   symbols with their counts, and a sequence of numbers with a break between pieces. Spark sums the
   counts over all chunks; symbols found less than ``min_count`` times cannot be part of a candidate.
2. The others are numbered by rank of frequency (range partitions with running counts: no task
   holds a whole vocabulary), and each chunk's sequence is rewritten in ranks.
3. Adjacent ranks ``(i, j)`` are a cell of tile ``(i // SIDE, j // SIDE)``. Frequent words crowd into the
   tiles of low ranks: these are counted by direct address (numpy ``bincount``), pairs of all other tiles
   as sorted coordinates with counts. Tiles are spread over buckets by hash, dense ones first summed per
   salt, and added up there in the same two forms.

Words are level one. The frequent pairs are ranked again and are the symbols of level two: a pair of
adjacent pairs is a phrase of three words. Which places hold a frequent pair is looked up in a filter of
fixed size (``FILTER_BITS``) before the exact join; what it lets through wrongly costs time only.

Scores are whole numbers of 38 digits. Phrases travel as ranks until the end.

Defined results: a null or empty text has no words; a null language is ``und``, and one that is called so
is the same language; texts are counted once per row, so repeated rows count repeatedly; ties go to the
phrase that is smaller in UTF-8 byte order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ..session import spread
from ._common import discard, mix64, stored

MIN_COUNT = 10
COVER_PERCENT = 50
TOP = 2000
CHUNK_BYTES = 4_000_000
#: All open chunks of a task together.
HELD_BYTES = 12_000_000
#: Pairs that a task holds before it counts them.
HELD_PAIRS = 1_000_000
SIDE = 512
#: Tile (x, y) is dense where (x + 1) * (y + 1) is at most this.
DENSE_TILES = 8
FILTER_BITS = 1 << 26
#: Words for which there is a bucket of pairs, and rows a salt keeps of a language.
BUCKET_PAIRS = 2_000_000
SALTS = 32

_BREAK = 0xFF  # a byte that no UTF-8 text holds
#: Punctuation and line ends end a piece, the tab separates words, ASCII letters go to lower case.
_MAP = bytes(
    _BREAK if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, with the break byte between pieces."""
    return text.translate(_MAP).replace(b"\xff", b" \xff ").split(b" ")


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes: sequences and blocks are most of what is written and shuffled."""
    raw = numbers.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, kind)


# ---------------------------------------------------------------- chunks


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts -> dictionary-encoded chunks of one language each."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    number = TaskContext.get().partitionId() << 32

    def chunk(lang: str) -> pd.DataFrame:
        nonlocal number
        number += 1
        size.pop(lang)
        flat = [w for w in words(b"\xff".join(held.pop(lang))) if w]
        coded = pa.array(flat, pa.binary()).dictionary_encode()
        symbols = coded.dictionary.to_pylist()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        counts = np.bincount(ids, minlength=len(symbols))
        if b"\xff" in symbols:
            at = symbols.index(b"\xff")
            ids = np.where(ids == at, -1, ids - (ids > at)).astype(np.int32)
            counts = np.delete(counts, at)
            del symbols[at]
        row = {"chunk": number, "lang": lang, "ids": _pack(ids), "counts": counts, "symbols": symbols}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text) + 1
            if size[lang] >= CHUNK_BYTES:
                yield chunk(lang)
            while sum(size.values()) >= HELD_BYTES:
                yield chunk(max(size, key=size.get))
    while size:
        yield chunk(next(iter(size)))


def _ranks(symbols: DataFrame, *key: str) -> DataFrame:
    """``symbols`` with ``rank``: its place in its language by falling ``f``, then by ``key``."""
    order = [F.col("lang"), F.col("f").desc(), *[F.col(k) for k in key]]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = symbols.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", place), "ranks")
    parts = dealt.groupBy("lang", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    before = F.sum("rows").over(Window.partitionBy("lang").orderBy("part")) - F.col("rows") - F.col("first")
    parts = parts.select("lang", "part", before.alias("shift"))  # one row per range partition and language
    return dealt.join(parts, ["lang", "part"]).withColumn("rank", F.col("place") + F.col("shift")).drop("place", "shift", "part")


def _in_ranks(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """``chunk``, ``lang`` and ``ids`` as ranks; ``entries(chunk, id, rank)`` lists the symbols that have one."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        for batch in batches:
            # A chunk's symbols, then the chunk itself: the row that has no code.
            last = np.flatnonzero(batch.column(1).is_null().to_numpy(zero_copy_only=False))
            begin = 0
            for row in [*last, len(batch)]:
                codes.append(batch.column(1).slice(begin, row - begin).to_numpy(zero_copy_only=False).astype(np.int64))
                begin = row + 1
                if row == len(batch):
                    continue
                ids, code = _unpack(batch.column(2)[row].as_py(), np.int32), np.concatenate(codes)
                to = np.full(int(ids.max(initial=-1)) + 2, -1, np.int32)  # the last place is for the break, -1
                to[code >> 32] = code & 0xFFFFFFFF
                codes = []
                columns = [batch.column(0).slice(row, 1), pa.array([_pack(to[ids])], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "ids"])

    code = F.shiftleft(F.col("id").cast("long"), 32) + F.col("rank")  # one number per entry keeps the shuffle narrow
    symbols = entries.select("chunk", code.alias("code"), F.lit(None).cast("binary").alias("ids"))
    whole = chunks.select("chunk", F.lit(None).cast("long").alias("code"), "ids")
    both = symbols.unionByName(whole).repartition("chunk").sortWithinPartitions("chunk", F.col("code").asc_nulls_last())
    return both.mapInArrow(rewrite, "chunk long, ids binary").join(chunks.select("chunk", "lang"), "chunk")


# ---------------------------------------------------------------- tiles


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys with summed counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _block(lang: str, bucket: int, salt: int, tile: int, keys: np.ndarray, counts: np.ndarray) -> dict:
    """Sorted ``keys`` with counts: cells of a tile, or (tile -1) pairs ``i << 32 | j``."""
    steps = np.diff(keys.astype(np.int64), prepend=0)
    return {"lang": lang, "bucket": bucket, "salt": salt, "tile": tile, "keys": _pack(steps), "counts": _pack(counts.astype(np.int64))}


def _tile_of(key: np.ndarray) -> np.ndarray:
    return ((key >> 32) // SIDE << 32) | ((key & 0xFFFFFFFF) // SIDE)


def _is_dense(tile: np.ndarray) -> np.ndarray:
    """Tiles of low ranks, by a rule on their place alone, so that all tasks agree."""
    return ((tile >> 32) + 1) * ((tile & 0xFFFFFFFF) + 1) <= DENSE_TILES


def _count_tiles(buckets: int, salts: int):
    """Rank sequences -> blocks of pair counts, dense tiles by direct address, the rest as sorted coordinates."""

    def blocks(lang: str, pairs: list[np.ndarray], salt: int) -> list[dict]:
        key = np.concatenate(pairs)
        tile = _tile_of(key)
        dense = _is_dense(tile)
        made = []
        for t in np.unique(tile[dense]):
            inside = key[tile == t]
            counted = np.bincount(((inside >> 32) % SIDE) * SIDE + (inside & 0xFFFFFFFF) % SIDE, minlength=SIDE * SIDE)
            used = np.flatnonzero(counted)
            bucket = int(mix64(np.array([t], np.uint64))[0] % np.uint64(buckets))
            made.append(_block(lang, bucket, salt, int(t), used, counted[used]))
        key, count = np.unique(key[~dense], return_counts=True)
        bucket = (mix64(_tile_of(key).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        for b in np.unique(bucket):
            at = order[(ends[b - 1] if b else 0) : ends[b]]
            made.append(_block(lang, int(b), 0, -1, key[at], count[at]))
        return made

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = TaskContext.get().partitionId() % salts
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def ready(limit: int) -> Iterator[pd.DataFrame]:
            while sum(size.values()) > limit:
                lang = max(size, key=size.get)
                size.pop(lang)
                yield pd.DataFrame(blocks(lang, held.pop(lang), salt))

        for batch in batches:
            for lang, ids in zip(batch["lang"], batch["ids"]):
                ids = _unpack(ids, np.int32).astype(np.int64)
                both = (ids[:-1] >= 0) & (ids[1:] >= 0)
                pairs = (ids[:-1] << 32 | ids[1:])[both]
                if len(pairs):
                    held.setdefault(lang, []).append(pairs)
                    size[lang] = size.get(lang, 0) + len(pairs)
                    yield from ready(HELD_PAIRS)
        yield from ready(0)

    return run


def _add_tiles(min_count: int, last: bool):
    """Blocks of one bucket (and salt) added up: dense tiles in arrays, coordinates by sorted merges.

    Coordinates are complete here: pairs found less than ``min_count`` times go. Dense tiles are complete
    in the last round only, when their salts are added up.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tiles: dict[tuple, np.ndarray] = {}
        sparse: dict[str, list] = {}
        waiting: dict[str, int] = {}
        for batch in batches:
            for lang, bucket, tile, keys, counts in zip(*[batch[c] for c in ("lang", "bucket", "tile", "keys", "counts")]):
                keys, counts = np.cumsum(_unpack(keys, np.int64)), _unpack(counts, np.int64)
                if tile >= 0:
                    tiles.setdefault((lang, bucket, tile), np.zeros(SIDE * SIDE, np.int64))[keys] += counts
                    continue
                parts = sparse.setdefault(lang, [])
                parts.append((keys, counts))
                waiting[lang] = waiting.get(lang, 0) + len(keys)
                if waiting[lang] > max(HELD_PAIRS, 2 * len(parts[0][0])):
                    sparse[lang], waiting[lang] = [_merged(*zip(*parts))], 0
        for (lang, bucket, tile), cells in tiles.items():
            used = np.flatnonzero(cells >= min_count if last else cells)
            yield pd.DataFrame([_block(lang, bucket, 0, tile, used, cells[used])])
        for lang in list(sparse):
            key, count = _merged(*zip(*sparse.pop(lang)))
            key, count = key[count >= min_count], count[count >= min_count]
            yield pd.DataFrame([_block(lang, 0, 0, -1, key, count)])

    return run


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks -> a row per pair."""
    for batch in batches:
        for lang, tile, keys, counts in zip(*[batch[c] for c in ("lang", "tile", "keys", "counts")]):
            key, count = np.cumsum(_unpack(keys, np.int64)), _unpack(counts, np.int64)
            if tile >= 0:
                key = ((tile >> 32) * SIDE + key // SIDE) << 32 | ((tile & 0xFFFFFFFF) * SIDE + key % SIDE)
            yield pd.DataFrame({"lang": lang, "i": key >> 32, "j": key & 0xFFFFFFFF, "f": count})


def _pairs(sequences: DataFrame, total: int, min_count: int) -> DataFrame:
    """``lang``, ``i``, ``j``, ``f``: adjacent ranks found at least ``min_count`` times; ``total`` bounds their number."""
    spark = sequences.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_PAIRS))
    salts = max(1, round(sequences.rdd.getNumPartitions() ** 0.5))
    schema = "lang string, bucket int, salt int, tile long, keys binary, counts binary"
    counted = sequences.select("lang", "ids").mapInPandas(_count_tiles(buckets, salts), schema)
    added = counted.repartition(buckets, "bucket", "salt").mapInPandas(_add_tiles(min_count, False), schema)
    added = stored(added, "tiles")  # small: complete coordinates, and one part of each dense tile per salt
    dense = added.where("tile >= 0").repartition(buckets, "bucket").mapInPandas(_add_tiles(min_count, True), schema)
    return added.where("tile < 0").unionByName(dense).mapInPandas(_rows, "lang string, i long, j long, f long")


# ---------------------------------------------------------------- pairs as symbols


def _bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        key = (batch["i"].to_numpy(np.int64) << 32 | batch["j"].to_numpy(np.int64)).view(np.uint64)
        bit = np.unique((mix64(key) % np.uint64(FILTER_BITS)).astype(np.int64))
        yield pd.DataFrame({"word": bit >> 6, "bits": np.left_shift(1, bit & 63)})


def _pair_filter(pairs: DataFrame) -> np.ndarray:
    """One bit per hash of a frequent pair: at most ``FILTER_BITS`` / 64 rows come to the driver, whatever the pairs."""
    held = pairs.select("i", "j").mapInPandas(_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = held.toPandas()
    flags = np.zeros(FILTER_BITS // 64, np.int64)
    flags[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return flags


def _pair_chunks(sequences: DataFrame, flags: np.ndarray) -> DataFrame:
    """Chunks whose symbols are adjacent ranks that pass the filter."""
    spark = sequences.sparkSession
    shared = spark.sparkContext.broadcast(flags)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = shared.value
        for batch in batches:
            for chunk, lang, ids in zip(batch["chunk"], batch["lang"], batch["ids"]):
                ids = _unpack(ids, np.int32).astype(np.int64)
                key = ids[:-1] << 32 | ids[1:]
                bit = (mix64(key.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
                kept = (ids[:-1] >= 0) & (ids[1:] >= 0) & (flags[bit >> 6] >> (bit & 63) & 1 == 1)
                symbols, at = np.unique(key[kept], return_inverse=True)
                out = np.full(len(key), -1, np.int32)
                out[kept] = at
                yield pd.DataFrame({"chunk": [chunk], "lang": [lang], "ids": [_pack(out)], "symbols": [symbols]})

    return sequences.mapInPandas(run, "chunk long, lang string, ids binary, symbols array<long>")


# ---------------------------------------------------------------- candidates


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits."""
    big = "decimal(38,0)"
    product = (F.lit(1_000_000).cast(big) * a.cast("decimal(18,0)")).cast(big) * a.cast("decimal(18,0)")
    return F.call_function("div", product.cast(big), (left.cast("decimal(18,0)") * right.cast("decimal(18,0)")).cast(big))


def _first(rows: DataFrame, k: int) -> DataFrame:
    """Each language's first ``k`` rows: first per salt, so that one task ranks a bounded number of rows."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    kept = rows.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    cover_percent: int = COVER_PERCENT,
    top: int = TOP,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the strongest phrases of two and three words."""
    texts = docs.select(
        F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    )
    schema = "chunk long, lang string, ids binary, counts array<long>, symbols array<binary>"
    chunks = stored(spread(texts).mapInPandas(_chunks, schema), "chunks", compression="zstd")
    entries = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("symbols", "counts")).alias("id", "of"))
    entries = entries.select("chunk", "lang", "id", F.col("of.symbols").alias("word"), F.col("of.counts").alias("n"))
    size = stored(entries.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    total = size.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    counts = entries.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    vocabulary = stored(_ranks(counts, "word"), "vocabulary")
    known = entries.join(vocabulary, ["lang", "word"]).select("chunk", "id", "rank")
    sequences = stored(_in_ranks(chunks, known), "sequences")
    discard(chunks)
    pairs = stored(_ranks(_pairs(sequences, total, min_count), "i", "j"), "pairs")

    pair_chunks = stored(_pair_chunks(sequences, _pair_filter(pairs)), "pair-chunks")
    discard(sequences)
    pair_entries = pair_chunks.select("chunk", "lang", F.posexplode("symbols").alias("id", "key"))
    keyed = pairs.select("lang", (F.shiftleft("i", 32) + F.col("j")).alias("key"), "rank")
    known = pair_entries.join(keyed, ["lang", "key"]).select("chunk", "id", "rank")
    pair_sequences = stored(_in_ranks(pair_chunks, known), "pair-sequences")
    discard(pair_chunks)
    triples = stored(_pairs(pair_sequences, total, min_count), "triples")
    discard(pair_sequences)

    word = lambda at, name, f: vocabulary.select(
        "lang", F.col("rank").alias(at), F.decode("word", "UTF-8").alias(name), F.col("f").alias(f)
    )
    two = pairs.withColumnRenamed("f", "a").join(word("i", "w1", "f1"), ["lang", "i"]).join(word("j", "w2", "f2"), ["lang", "j"])
    two = stored(two.select("lang", "rank", "a", "w1", "f1", "w2", "f2"), "two-words")
    head = two.select("lang", F.col("rank").alias("i"), "w1", "f1", "w2", F.col("a").alias("f12"))
    tail = two.select("lang", F.col("rank").alias("j"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
    three = triples.withColumnRenamed("f", "a").join(head, ["lang", "i"]).join(tail, ["lang", "j"])
    three = three.withColumns({"s1": _score(F.col("a"), F.col("f1"), F.col("f23")), "s2": _score(F.col("a"), F.col("f12"), F.col("f3"))})
    early = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang",
        F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
        "a",
        F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    inside = triples.select("lang", F.col("i").alias("rank"), "f").unionByName(triples.select("lang", F.col("j").alias("rank"), "f"))
    inside = inside.groupBy("lang", "rank").agg(F.max("f").alias("longer"))
    covered = F.coalesce(100 * F.col("longer") >= cover_percent * F.col("a"), F.lit(False))
    two = two.join(inside, ["lang", "rank"], "left").where(~covered)
    score = _score(F.col("a"), F.col("f1"), F.col("f2")).alias("score")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score)
    best = _first(two.unionByName(three), top).join(size, "lang")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
