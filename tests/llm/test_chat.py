"""Reply trees, the template's round trip, and conversations as chains."""

from pyspark.sql import functions as F

from folio.llm import chat

NODES = "tree long, node long, parent long, score double, role string, text string"


def paths_of(spark, rows, best):
    frame = spark.createDataFrame(rows, NODES)
    got = chat.reply_paths(frame, best).collect()
    out = {}
    for r in got:
        out.setdefault((r["tree"], r["leaf"], r["rank"], round(r["path_score"], 6)), []).append((r["depth"], r["node"]))
    return {k: [n for _, n in sorted(v)] for k, v in out.items()}


def brute(rows):
    """All root-to-leaf paths by walking up."""
    trees = {}
    for tree, node, parent, score, *_ in rows:
        trees.setdefault(tree, {})[node] = (parent, score or 0.0)
    out = {}
    for tree, nodes in trees.items():
        found = []
        for leaf in nodes.keys() - {p for p, _ in nodes.values()}:
            path, at = [], leaf
            while at in nodes:
                path.append(at)
                at = nodes[at][0]
            found.append((sum(nodes[n][1] for n in path), leaf, path[::-1]))
        for rank, (score, leaf, path) in enumerate(sorted(found, key=lambda f: (-f[0], f[1])), 1):
            out[(tree, leaf, rank, round(score, 6))] = path
    return out


def test_paths_equal_brute_force(spark):
    rows = [(t, n, (n * 7 + t) // 9 if n else None, (n * 31 % 17) / 4, "user", "x") for t in range(3) for n in range(40)]
    rows = [r if r[1] != r[2] else (*r[:2], None, *r[3:]) for r in rows]
    rows += [(9, n, n - 1 if n else None, None, "user", "x") for n in range(70)]  # a chain, null scores
    rows += [(8, 5, 99, 1.0, "user", "x"), (None, 1, None, 2.0, "user", "x")]  # a missing parent, a null tree
    assert paths_of(spark, rows, None) == brute(rows)
    best = {k: v for k, v in brute(rows).items() if k[2] <= 2}
    assert paths_of(spark, rows, 2) == best


def test_cycles_and_repeats(spark):
    rows = [(1, 1, 2, 1.0, "user", "a"), (1, 2, 1, 1.0, "user", "b"), (1, 3, 2, 1.0, "user", "c")]
    rows += [(2, 1, None, 1.0, "user", "a"), (2, 1, None, 1.0, "user", "a"), (2, 2, 1, 0.0, "assistant", "b")]
    assert paths_of(spark, rows, None) == {(2, 2, 1, 1.0): [1, 2]}
    assert paths_of(spark, [], None) == {}


TEXTS = ["", "a", "</s>[INST] ok [/INST]", "\\", "\\\\", "<\\|turn|>", "<|turn|><|says|><|end|>", "[[INST]]", "<s>\\</s>\n", "<", "$1\\2", "é😀"]


def test_escape_round_trip(spark):
    texts = TEXTS + [a + b for a in TEXTS for b in TEXTS]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for t, e, u in frame.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert u == t
        for control in ("<s>", "</s>", "<|", "[INST]", "[/INST]"):
            assert control not in e


def test_conversations_round_trip(spark):
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(["system", "user", "assistant"] * 4, TEXTS))]
    rows += [(2, 0, None, None), (2, None, "assistant", "late"), (2, 0, "assistant", "tie")]
    rows += [(3, t * 1000, "user", str(t)) for t in range(200)]  # many blocks, one conversation
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = chat.chain(frame, "conv_id", "turn", "role", "text")
    made = chat.format_paths(chat.reply_paths(messages), messages)
    read = chat.read_back(F.col("formatted"), F.col("mask"))
    got = {r["tree"]: r for r in made.select("tree", *[c.alias(k) for k, c in read.items()]).collect()}
    for conv in (1, None, 2, 3):
        own = [r for r in rows if r[0] == conv]
        own = sorted(own, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv]["trained"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
    empty = spark.createDataFrame([], frame.schema)
    none = chat.chain(empty, "conv_id", "turn", "role", "text")
    assert chat.format_paths(chat.reply_paths(none), none).count() == 0


def test_main_path_is_native(spark, sf_small):
    from folio.llm.queries import QUERIES

    plan = QUERIES["op1_chat_format"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
