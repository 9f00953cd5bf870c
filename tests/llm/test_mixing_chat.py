"""Hierarchical budgets and snapshot collapse against plain Python."""

import hashlib
import random

import pytest

from lanternq.llm import chat as C
from lanternq.llm import mixing as M


def fill(total, children):
    """Water-filling one child at a time: {name: (weight, capacity)} -> {name: share}."""
    out, left, open_ = {}, total, dict(children)
    while open_:
        w = sum(x for x, _ in open_.values())
        full = [k for k, (x, cap) in open_.items() if cap * w <= left * x]
        if not full:
            return out | {k: left * x // w for k, (x, _) in open_.items()}
        first = min(full, key=lambda k: (open_[k][1] / open_[k][0], k))
        out[first] = open_[first][1]
        left -= open_.pop(first)[1]
    return out


def plain_mixture(rows, share=0.6, epochs=3, seed=17):
    domain = lambda s: f"domain{int(s[3:]) % 4}" if s[3:].isdigit() else "other"
    n = lambda t: len((t or "").encode().split())
    leaves = {}
    for k, t, lang, source in rows:
        leaves.setdefault((domain(source or ""), lang or "", source or ""), []).append((k, n(t)))
    cap = lambda p: epochs * sum(x for leaf, d in leaves.items() if leaf[: len(p)] == p for _, x in d)
    weights = (M.DOMAIN_WEIGHTS, M.LANG_WEIGHTS, {})
    budget = {(): int(share * sum(x for d in leaves.values() for _, x in d))}
    for level in range(3):
        for p in {leaf[:level] for leaf in leaves}:
            kids = {leaf[: level + 1] for leaf in leaves if leaf[:level] == p}
            budget |= fill(budget[p], {k: (weights[level].get(k[-1], 1), cap(k)) for k in kids})
    out = {}
    for leaf, d in leaves.items():
        total, b = sum(x for _, x in d), budget[leaf]
        full = b // total if total else epochs
        left = b - full * total
        run = 0
        key = lambda k, full=full: hashlib.md5(f"{seed}-{full + 1}-{k}".encode()).hexdigest()
        for k, x in sorted(d, key=lambda z: key(z[0])):
            run += x
            out[k] = full + (1 if left > 0 and run <= left else 0)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mixture_equals_plain(docs, words, seed):
    r = random.Random(seed)
    rows = [(i, words(i, r.randrange(60)), r.choice(["en", "en", "de", "fr", None]), r.choice(["src0"] * 6 + ["src1", "src2", "src3", "src5", "web", None])) for i in range(400)]
    got = {x["doc_id"]: x["copies"] for x in M.mixture(docs(rows)).collect()}
    assert got == plain_mixture(rows)
    again = M.mixed(docs(rows)).groupBy("doc_id").count().collect()
    assert {x["doc_id"]: x["count"] for x in again} == {k: v for k, v in got.items() if v}


def test_mixture_odd(odd, none):
    got = M.mixture(odd).collect()
    assert len(got) == 10 and all(0 <= r["copies"] <= 3 for r in got)
    assert set(M.mixed(odd).columns) == set(odd.columns)
    assert M.mixture(none).count() == 0


def conversations(seed):
    r = random.Random(seed)
    rows, k = [], 0
    for _ in range(12):
        turns = [(r.choice(["user", "assistant"]), r.choice("abc")) for _ in range(r.randrange(1, 7))]
        for cut in {len(turns), r.randrange(1, len(turns) + 1), r.randrange(1, len(turns) + 1)}:
            for _ in range(r.randrange(1, 3)):
                rows += [(k, i, role, text) for i, (role, text) in enumerate(turns[:cut])]
                k += 1
    return rows


def plain_chat(rows):
    convs = {}
    for k, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(k, []).append((role or "", text or ""))
    kept = [k for k, t in convs.items() if not any((len(o) > len(t) and o[: len(t)] == t) or (o == t and j < k) for j, o in convs.items())]
    return sorted((k, "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in convs[k])) for k in kept)


SCHEMA = "conv_id long, turn long, role string, text string, block string, x long, place int"


@pytest.mark.parametrize("seed", range(3))
def test_chat_equals_plain(spark, seed):
    rows = conversations(seed)
    got = C.chat_documents(spark.createDataFrame([(*r, "b", 1, 2) for r in rows], SCHEMA)).collect()
    assert sorted((r["conv_id"], r["text"]) for r in got) == plain_chat(rows)


def test_chat_odd(spark):
    rows = [(1, 0, None, None), (1, None, "user", "z"), (2, 0, "", ""), (None, 0, "user", "lost"), (3, 5, "user", "a"), (3, 5, "user", "a"), (4, 9, "user", "a"), (5, 0, "user", "x" * 100_000)]
    got = C.chat_documents(spark.createDataFrame([(*r, "b", 1, 2) for r in rows], SCHEMA)).collect()
    assert sorted((r["conv_id"], r["text"]) for r in got) == plain_chat(rows)
    assert C.chat_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chat_over_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 4)
    monkeypatch.setattr(C, "CHUNK", 5)
    rows = [(1, i, "user", str(i)) for i in range(23)] + [(2, i, "user", str(i)) for i in range(17)] + [(3, i, "user", str(i)) for i in range(16)] + [(3, 16, "user", "no")]
    got = sorted((r["conv_id"], r["chunk"], r["text"]) for r in C.chat_documents(spark.createDataFrame([(*r, "b", 1, 2) for r in rows], SCHEMA)).collect())
    joined = {}
    for k, _, t in got:
        joined[k] = joined.get(k, "") + t
    assert sorted(joined.items()) == plain_chat(rows)
    assert len(got) == 5 + 4
