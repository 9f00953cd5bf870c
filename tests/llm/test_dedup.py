"""Exact dedup and SimHash groups against brute force."""

import hashlib
import itertools
import random
import re

import xxhash

from lanternq.llm import exact_dedup as E
from lanternq.llm import simhash as S


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, (k, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((k is None, k, i))
    out = []
    for text, g in groups.items():
        keep = min(g, key=lambda x: (x[0], x[1] or 0))[1]
        out += [(k, keep, len(g), hashlib.sha256(text.encode()).hexdigest()) for _, k, _ in g]
    return sorted(out, key=repr), len(groups)


def check_exact(df, rows):
    got = E.exact_dedup(df).collect()
    want, groups = brute_exact(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_odd(odd, docs):
    from .conftest import ODD

    check_exact(odd, ODD)


def test_exact_hot_group_is_split(docs, words):
    rows = [(i, words(i % 40, 12) if i % 3 else "the  same\ttext") for i in range(900)]
    random.Random(1).shuffle(rows)
    check_exact(docs(rows), rows)


def test_exact_empty(none):
    assert E.exact_dedup(none).count() == 0


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    marks = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (marks[a] ^ marks[b]).bit_count() <= 4:
            root[find(b)] = find(a)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((k, f"{marks[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def check_groups(df, rows):
    assert sorted((tuple(r)[:3] for r in S.near_groups(df).collect()), key=repr) == brute_groups(rows)


def edited(words, seed):
    """A text and copies with a few words changed, so that fingerprints lie close."""
    r = random.Random(seed)
    out = []
    for k in range(12):
        base = words(seed * 100 + k, 150).split()
        for _ in range(r.randrange(1, 8)):
            own = list(base)
            for _ in range(r.randrange(4)):
                own[r.randrange(len(own))] = f"new{r.randrange(99)}"
            out.append(" ".join(own))
    return out


def test_groups_odd(odd):
    from .conftest import ODD

    check_groups(odd, ODD)


def test_groups(docs, words):
    rows = list(enumerate(edited(words, 1)))
    check_groups(docs(rows), rows)


def test_groups_over_blocks(docs, words, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    rows = list(enumerate(edited(words, 2)))
    check_groups(docs(rows), rows)


def test_groups_empty(none):
    assert S.near_groups(none).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    masks = S.covering_masks()
    assert len(masks) == 31
    for n in (1, 2, 3):
        for bits in itertools.combinations(range(64), n):
            flip = sum(1 << b for b in bits)
            assert any(not m & flip for m in masks)
    r = random.Random(4)
    for _ in range(50_000):
        flip = sum(1 << b for b in r.sample(range(64), 4))
        assert any(not m & flip for m in masks)


def test_forest_connects_what_pairs_connect():
    import numpy as np

    r = random.Random(9)
    for _ in range(50):
        marks = sorted({r.getrandbits(12) for _ in range(40)})
        got = S.forest(np.array(marks, np.uint64), 2)
        root = {m: m for m in marks}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in itertools.combinations(marks, 2):
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
        mine = {m: m for m in marks}
        for a, b in got:
            mine[find(b, mine)] = find(a, mine)
        for a, b in itertools.combinations(marks, 2):
            assert (find(a) == find(b)) == (find(a, mine) == find(b, mine))


def planned(monkeypatch, module):
    """(name, plan) of each table that ``module`` parks from now on."""
    found = []

    def parked(df, name="table", own=module.parked):
        found.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return own(df, name)

    monkeypatch.setattr(module, "parked", parked)
    return found


def test_groups_leave_nothing_that_grows_to_the_driver(docs, words, monkeypatch):
    from lanternq.operators import components as C

    monkeypatch.setattr(C, "FEW", -1)
    plans, rounds = planned(monkeypatch, S), planned(monkeypatch, C)
    rows = list(enumerate(edited(words, 3)))
    out = S.near_groups(docs(rows))
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    joins = {"met", "rooted", "named", "out", "large", "small"}
    assert joins <= {name for name, _ in plans + rounds}
    assert not [name for name, plan in plans + rounds if name in joins and "BroadcastHashJoin" in plan]
    assert sorted((tuple(r)[:3] for r in out.collect()), key=repr) == brute_groups(rows)


def test_representatives_leave_nothing_that_grows_to_the_driver(docs, words, monkeypatch):
    plans = planned(monkeypatch, S)
    rows = list(enumerate(edited(words, 4)))
    out = S.representatives(docs(rows))
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    joins = {"met", "kept", "out"}
    assert joins <= {name for name, _ in plans}
    assert not [name for name, plan in plans if name in joins and "BroadcastHashJoin" in plan]
    assert {r["doc_id"] for r in out.collect()} == {low for _, _, low in brute_groups(rows)}
