"""Token counts against a plain Viterbi search; the token store against the library and its own files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lanternq.llm import token_counts as C
from lanternq.llm import token_store as S
from lanternq.llm.perfect_hash import PerfectHash, fingerprint

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def unigram():
    return C.Unigram(PIECES)


def viterbi(model, word):
    path = C.MARK + word
    best = [(0.0, 0)] + [None] * len(path)
    for end in range(1, len(path) + 1):
        found = []
        for start in range(end):
            score = model.scores.get(path[start:end])
            if score is not None:
                found.append((best[start][0] + score, best[start][1] + 1))
        if path[end - 1] not in model.scores:
            width = len(path[end - 1].encode())
            found.append((best[end - 1][0] + width * model.byte, best[end - 1][1] + width))
        best[end] = max(found, key=lambda x: (x[0], -x[1]))
    return best[-1][1]


def test_trie_counts_equal_plain_search(unigram, words):
    some = set(words(1, 400).split()) | {"a", "ab", "abc", "😀", "x😀y", "É", "zzzzzzzz", "the", "there", "they", "1234", "é́"}
    trie = C.Trie(unigram)
    got = {w: trie.count(w) for w in [*some, *some]}
    assert len(trie.forward) - 1 == len({(C.MARK + w)[:i] for w in some for i in range(1, len(w) + 2)})
    assert got == {w: viterbi(unigram, w) for w in some}


def test_counts_of_documents(odd, unigram):
    from .conftest import ODD

    got = sorted((tuple(r) for r in C.token_counts(odd, PIECES).collect()), key=repr)
    want = []
    for k, t in ODD:
        w = [x.decode() for x in (t or "").encode().split()]
        want.append((k, len(w), sum(viterbi(unigram, x) if len(x) < 500 else C.Trie(unigram).count(x) for x in w)))
    assert got == sorted(want, key=repr)


def test_cache_turns_over(docs, words, monkeypatch, unigram):
    monkeypatch.setattr(C, "CACHE_WORDS", 5)
    monkeypatch.setattr(C, "NODES", 9)
    monkeypatch.setitem(C._counters, PIECES, C.Counter(unigram))
    import pyarrow as pa

    texts = [words(i, 6).encode() for i in range(4)]
    out = next(C._counter(PIECES)(iter([pa.record_batch([pa.array(range(4)), pa.array(texts)], ["i", "t"])])))
    assert out.column(2).to_pylist() == [sum(viterbi(unigram, w.decode()) for w in t.split()) for t in texts]


def test_counts_of_bytes_that_are_not_text(spark, unigram):
    df = spark.sql("SELECT 1L AS doc_id, cast(unhex('FFFE2061') AS string) AS text")
    assert tuple(C.token_counts(df, PIECES).first()) == (1, 2, viterbi(unigram, "\ufffd\ufffd") + viterbi(unigram, "a"))


def test_counts_empty(none):
    assert C.token_counts(none, PIECES).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash(n):
    r = random.Random(n)
    keys = np.array(sorted({r.randrange(-(2**62), 2**62) for _ in range(n)}), np.int64)
    index = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(index.slots(keys).tolist()) == list(range(n))
    marks = np.zeros(n, np.uint32)
    marks[index.slots(keys)] = fingerprint(keys)
    other = np.array([r.randrange(2**62, 2**63 - 1) for _ in range(500)], np.int64)
    slots = index.slots(other)
    false = sum(1 for s, f in zip(slots.tolist(), fingerprint(other).tolist(), strict=True) if s >= 0 and marks[s] == f)
    assert false == 0


def expected(rows):
    t = Tokenizer.from_file(WORDS)
    start, out = 0, []
    for k, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_round_trip(docs, spark, words, tmp_path):
    rows = [(i * 3, words(i, i % 90)) for i in range(120)] + [(1000, None), (1001, ""), (1002, "<|endoftext|> it's 1,234 été... İstanbul ΣΑΣ"), (1003, "x" * 70_000), (1004, "a b c")]
    mixed = list(rows)
    random.Random(2).shuffle(mixed)
    store = f"file://{tmp_path}/store"
    S.write_store(docs(mixed), store, WORDS, shard_bytes=500)
    got = sorted(tuple(r) for r in S.read_documents(spark, store).collect())
    assert got == expected(rows)
    assert spark.read.parquet(store).count() > 3
    t = Tokenizer.from_file(WORDS)
    for k, text in (rows[7], rows[-2], rows[-3]):
        assert S.get(spark, store, k) == [[*t.encode(text or "", add_special_tokens=False).ids, 1]]
    assert S.get(spark, store, 1) == []


def test_store_repeats_and_nulls(docs, spark, tmp_path):
    rows = [(5, "b"), (5, "a"), (5, "a"), (None, "z"), (1, "q"), (None, None)]
    store = f"file://{tmp_path}/store"
    S.write_store(docs(rows), store, WORDS)
    got = S.read_documents(spark, store).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [1, 5, 5, 5, None, None]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert len(S.get(spark, store, 5)) == 3


def test_store_empty(none):
    assert S.token_documents(none, WORDS).count() == 0


def test_words_join_to_whole_texts(words):
    t, e = Tokenizer.from_file(WORDS), S.Encoder(WORDS, "<u2")
    texts = [words(i, 40) for i in range(20)] + ["Don't WON'T 's 12ab ab12 a.b,c;d :-) ...", "a b c\x1cd", "é é ́x", "ǅ ﬁ ŉ ß ẞ", "  lead", ""]
    assert [np.frombuffer(x, "<u2").tolist() for x in e(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


