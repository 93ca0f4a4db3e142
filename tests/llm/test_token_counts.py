"""Counts equal the library's on whole texts."""

import random

import sentencepiece

from folio.llm import token_counts as tc


def test_pretokens_equal_whole_texts():
    table = tc.PieceTable()
    parts = [" ", "  ", "a", "the", "\n", "\t", "▁", "é", "ﬁ", "　", "<s>", "</s>", "中", ".", "b ", "\x00", "😀", "$$$", "12"]
    random.seed(5)
    texts = ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(3000)]
    assert tc.count_slice(table, texts) == [table.whole(t) for t in texts]


def test_query_rows(odd_docs, odd_rows, no_docs, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=tc.model_path())
    for frame in (odd_docs, documents):
        rows = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
        want = [(i, len(t.encode()), len(model.encode(t)), len(model.encode(t)) > tc.LIMIT) for i, t in rows]
        got = [tuple(r) for r in tc.token_counts(frame).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert tc.token_counts(no_docs).count() == 0
