"""Decontamination, language, quality and fuzzy lines against brute force or held-out accuracy."""

import itertools
import random
import unicodedata
import zlib

import numpy as np
import pytest

from lanternq.llm import byte_cnn as Q
from lanternq.llm import decontaminate as D
from lanternq.llm import language_id as L
from lanternq.llm import line_dedup as N


def test_masks_find_every_window():
    for size in range(1, D.WINDOW + 1):
        masks = D.masks_for(size)
        for bad in itertools.combinations(range(size), size // D.ERRORS_PER):
            assert any(not {s + p for p in m} & set(bad) for m in masks for s in range(size - m[-1])), (size, bad)


def plain_leaks(text, items):
    w, out = D.words(text), []
    for i, t in items:
        b = D.words(t)
        size = min(len(b), D.WINDOW)
        need = size - size // D.ERRORS_PER
        # Words beyond the ends of the text count as substitutions.
        hit = size and any(sum(0 <= s + k < len(w) and w[s + k] == b[a + k] for k in range(size)) >= need for a in range(len(b) - size + 1) for s in range(-size, len(w)))
        if hit:
            out.append(i)
    return out


def test_leaks_equal_plain(docs, spark, words):
    r = random.Random(1)
    items = [(k, words(900 + k, n, 40)) for k, n in enumerate([1, 2, 4, 5, 9, 10, 14, 20, 21, 35, 0])]
    rows = []
    for k in range(60):
        own = words(k, 80, 40).split()
        part = items[r.randrange(len(items))][1].split()
        for _ in range(r.randrange(6)):
            if part:
                part[r.randrange(len(part))] = "changed"
        at = r.randrange(len(own))
        rows.append((k, " ".join(own[:at] + part + own[at:])))
    rows += [(100, None), (101, ""), (102, "!!!"), (None, items[7][1]), (103, items[9][1]), (103, items[9][1])]
    bench = spark.createDataFrame([*items, (50, None), (None, items[9][1])], "item_id long, text string")
    got = D.contaminated_documents(docs(rows), bench).collect()
    every = [*items, (None, items[9][1])]
    assert sorted(((x["doc_id"], sorted(x["item_ids"], key=repr), x["contaminated"]) for x in got), key=repr) == sorted(((k, sorted(f, key=repr), bool(f)) for k, t in rows for f in [plain_leaks(t, every)]), key=repr)


def test_leaks_in_blocks(docs, spark, words, monkeypatch):
    items = [(k, words(k, 25)) for k in range(6)]
    rows = [(k, words(50 + k, 20) + " " + items[k][1]) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r) for r in D.contaminated_documents(docs(rows), bench).select("doc_id", "item_ids").collect())
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    assert sorted(tuple(r) for r in D.contaminated_documents(docs(rows), bench).select("doc_id", "item_ids").collect()) == whole == [(k, [k]) for k in range(6)]


def test_leaks_empty(docs, none, spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.contaminated_documents(none, bench).count() == 0
    assert D.contaminated_documents(docs([(1, "a b c")]), bench.limit(0)).first()["contaminated"] is False


def plain_phrases(sample, text):
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n <= len(text) and text[i : i + n] in sample:
            n += 1
        count += 1
        i += max(1, n - 1)
    return count


@pytest.mark.parametrize("dense", [62, 3])
def test_phrases_equal_plain_search(words, monkeypatch, dense):
    monkeypatch.setattr(L, "DENSE", dense)
    texts = {"a": [words(1, 200)], "b": ["été là où ça " * 30], "c": ["".join(chr(0x4E00 + i * i % 997) for i in range(3000))]}
    parser = L.Parser(texts)
    some = [words(2, 50), "là été où", "", "zzz 12", "x" * 5000, texts["c"][0][100:400] + "丂 là", words(3, 900)]
    folded = [L.folded(t) for t in some]
    got = parser.phrases(folded)
    for j, k in enumerate(parser.languages):
        sample = "".join(chr(c) for c in parser.codes[L.folded(texts[k][0] + " ")[: L.SAMPLE_CHARS]] + 65)
        for i, f in enumerate(folded):
            assert got[i, j] == plain_phrases(sample, "".join(chr(c) for c in parser.codes[f] + 65))


def test_predictions_equal_plain_search(words):
    """The language whose count of phrases, normalised by both lengths, is smallest."""
    texts = {"a": [words(1, 300)], "b": ["été là où ça mère très " * 40], "c": ["".join(chr(0x4E00 + i * i % 997) for i in range(2000))]}
    parser = L.Parser(texts)
    some = [words(5, 40), "là mère été", texts["c"][0][500:520], "thereonan é", "Ω"]
    samples = {k: "".join(map(chr, L.folded(t[0] + " ")))[: L.SAMPLE_CHARS] for k, t in texts.items()}
    for text, (lang, score) in zip(some, parser.predict(some), strict=True):
        f = "".join(map(chr, L.folded(text)))
        bits = {k: plain_phrases(s, f) * np.log2(len(s)) / len(f) for k, s in samples.items()}
        assert lang == min(sorted(bits), key=bits.get)
        low = sorted(bits.values())
        assert score == pytest.approx(1 - low[0] / low[1])


def test_long_texts_teach_their_language(docs):
    rows = [(k, f"uno due tre quattro {k} " * 900, "it") for k in range(8)] + [(k, f"one two three four {k} " * 3, "en") for k in range(10, 18)]
    assert {r["doc_id"]: r["lang_pred"] for r in L.languages(docs(rows)).collect()} == {r[0]: r[2] for r in rows}


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.95


def test_languages_odd(odd, none, docs):
    got = {(r["doc_id"], r["lang_pred"]) for r in L.languages(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "en")} <= got
    assert L.languages(none).count() == 0
    assert L.languages(docs([(1, "words", None)])).first()["lang_pred"] == "und"


def test_scores_do_not_depend_on_neighbours():
    net = Q.ByteCNN()
    texts = [b"", b"a", b"the quick " * 300, b"x" * 127, b"x" * 128, b"x" * 129, bytes(range(256)) * 9]
    assert net.scores(texts) == pytest.approx([float(net.scores([t])[0]) for t in texts])


def plain_score(net, text):
    """The network as loops over a text's bytes: filters at every second byte, the best response of each chunk of two blocks, hidden layer, mean and maximum."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    n = (len(text) + Q.WIDTH - Q.STEP) // Q.BLOCK + 1
    data = text + bytes(n * Q.BLOCK - len(text))
    peaks = np.full((n, net.filters), -np.inf)
    for i in range(0, len(data) - Q.WIDTH + 1, Q.STEP):
        peaks[i // Q.BLOCK] = np.maximum(peaks[i // Q.BLOCK], sum(p["conv"][j, data[i + j]] for j in range(Q.WIDTH)))
    hidden = []
    for i in range(n):
        chunk = np.maximum(peaks[i : i + 2].max(0) + p["conv_b"], 0)
        hidden.append(np.maximum(chunk @ p["mix"] + p["mix_b"], 0))
    pooled = np.concatenate((np.mean(hidden, 0), np.max(hidden, 0)))
    return 1 / (1 + np.exp(-(pooled @ p["out"] + p["out_b"][0])))


def test_scores_equal_plain_convolution(words):
    net = Q.ByteCNN(5, 4, 3)
    texts = [b"", b"a", b"x" * 127, words(1, 60).encode(), bytes(range(256)) * 3, "été 😀".encode() * 70]
    assert net.scores(texts) == pytest.approx([plain_score(net, t) for t in texts], rel=1e-4)


def test_learned_once_from_a_repeated_id(docs, spark):
    rows = [(1, f"good words {k}") for k in range(40)] + [(3, "### !!!")]
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    seen = []
    model = Q.ByteCNN.fit

    def fit(self, texts, y, w):
        seen.append((len(texts), sorted(y.tolist())))
        return model(self, texts, y, w)

    Q.ByteCNN.fit = fit
    try:
        Q.learned(docs(rows), labels)
    finally:
        Q.ByteCNN.fit = model
    assert seen == [(2, [0.0, 1.0])]


def test_accepted_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(4, "good words here", 0.1, "x"), (5, None, None, None)], "doc_id long, text string, score double, `a.b` string")
    labels = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    got = Q.accepted(df, labels)
    assert got.columns == df.columns and set(map(tuple, got.collect())) <= set(map(tuple, df.collect()))


def test_gradients_equal_differences():
    net = Q.ByteCNN(3, 4, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, y, w = [b"good words here " * 20, b"### ### !!!" * 30, b"a"], np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        s = net.scores(texts)
        return float(-(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / w.sum())

    g = net.gradients(texts, y, w)
    for k, at in (("out", 2), ("out_b", 0), ("mix", (1, 2)), ("mix_b", 1), ("conv_b", 0), ("conv", (2, ord("o"), 1)), ("conv", (0, ord("#"), 0))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = loss()
        net.p[k][at] = old - 1e-3
        down = loss()
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = Q.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert sum(r["predicted"] for r in good) / len(good) >= 0.97
    assert sum(1 - r["predicted"] for r in bad) / len(bad) >= 0.9


def test_quality_odd(odd, none, spark):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    got = Q.quality_scores(odd, labels).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert Q.quality_scores(none, labels).count() == 0
    assert {r["score"] for r in Q.quality_scores(odd, labels.limit(0)).collect()} == {0.5}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_norm(line):
    """The normal form, character by character."""
    out = []
    for c in line.lower():
        kind = unicodedata.category(c)[0]
        c = "0" if kind == "N" else c if kind in "LM" else " "
        if not (c in "0 " and out and out[-1] == c):
            out.append(c)
    return "".join(out).strip()


def similar_lines(s, t):
    most = int(max(len(s), len(t)) * 0.2 + 1e-9)
    return abs(len(s) - len(t)) <= most and levenshtein(s, t) <= most


def plain_lines(marks, rows):
    """Occurrences that go, from all pairs of normalised lines by Levenshtein alone."""
    occ = []
    for k, t in rows:
        key = (k is None, k or 0)
        occ += [((*key, marks[(*key, t)], i), n) for i, x in enumerate((t or "").split("\n")) if t is not None and (n := plain_norm(x))]
    root = {n: n for _, n in occ}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for s, t in itertools.combinations(root, 2):
        if find(s) != find(t) and similar_lines(s, t):
            root[find(t)] = find(s)
    first = {}
    for o, n in sorted(occ):
        first.setdefault(find(n), o)
    return {o for o, n in occ if first[find(n)] != o}


def check_lines(docs, rows):
    df = docs(rows)
    marks = {(r["doc_id"] is None, r["doc_id"] or 0, r["text"]): r["m"] for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS m").collect()}
    gone = plain_lines(marks, rows)
    want = []
    for k, t in rows:
        lines = t.split("\n") if t is not None else None
        key = (k is None, k or 0, marks[(k is None, k or 0, t)])
        kept = None if lines is None else [x for i, x in enumerate(lines) if (*key, i) not in gone]
        want.append((k, 0 if lines is None else len(lines), 0 if lines is None else len(lines) - len(kept), None if lines is None else "\n".join(kept)))
    got = [tuple(r) for r in N.line_dedup(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return sum(r[2] for r in got)


def fuzzy(words, seed):
    r = random.Random(seed)
    base = [words(seed * 50 + k, r.randrange(4, 60)) for k in range(14)]
    rows = []
    for k in range(45):
        lines = []
        for _ in range(r.randrange(1, 5)):
            w = r.choice(base).split()
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = f"new{r.choice('abcd')}"
            lines.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
        rows.append((k, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("split", [256, 2])
def test_lines_equal_plain(docs, words, monkeypatch, split):
    monkeypatch.setattr(N, "SPLIT", split)
    assert check_lines(docs, fuzzy(words, split)) > 20


def test_lines_odd(docs, none):
    from .conftest import ODD

    check_lines(docs, [*ODD[:6], (9, "\n\n!!\n1 2\n3 4\n"), (9, "other\nother"), (10, "w " * 3000)])
    assert N.line_dedup(none).count() == 0


def test_line_breaks_and_digits(docs):
    rows = [(1, "« Le petit – chat » 12"), (2, "le petit chat 7"), (3, "LE PETIT — CHAT, 123"), (4, "…—!"), (5, "…—!"), (6, "short"), (7, "other")]
    got = {r["doc_id"]: r["n_dropped"] for r in N.line_dedup(docs(rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0}


def test_very_long_lines(docs, words):
    """Lines that are compared by pieces and by words: one word in fifty, one letter in sixty, a block moved in, and a stranger."""
    a = words(1, 3000)
    w = a.split()
    spaced = [f"q{i}" if i % 50 == 7 else x for i, x in enumerate(w)]
    letters = "".join("z" if i % 60 == 9 and c != " " else c for i, c in enumerate(a))
    rows = [(1, a), (2, " ".join(spaced)), (3, letters), (4, " ".join(w[:900] + words(2, 200).split() + w[900:])), (5, words(3, 3000)), (6, "w " * 30_000)]
    assert {r["doc_id"]: r["n_dropped"] for r in N.line_dedup(docs(rows)).collect()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0}


def test_lines_of_middle_length_are_decided_by_characters(spark, words):
    """A piece of which half the letters differ, and a letter in each of six more words: neither pieces nor words show that a tenth of the line differs."""
    s = words(3, 200)[:640].strip()
    t = "".join("z" if i % 2 and i < 120 and c != " " else c for i, c in enumerate(s)).split()
    for i in range(-4, -34, -5):
        t[i] = "q" + t[i][1:]
    t = " ".join(t)
    assert N.WORDY < len(s) <= N.WHOLE and 24 < levenshtein(s, t) <= 0.15 * len(s)
    far = "".join("z" if i % 3 == 0 and c != " " else c for i, c in enumerate(s))
    assert levenshtein(s, far) > 0.2 * len(s) + 1
    texts = spark.createDataFrame([(1, s), (2, t), (3, far)], "lid long, norm string")
    assert N._similar(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), texts).collect() == [(1, 2)]


def test_each_component_is_first_compared_by_its_most_alike_pair(spark):
    pairs = spark.createDataFrame([(1, 2, 3), (1, 5, 4), (2, 5, 1), (6, 7, 9)], "a long, b long, differ int")
    roots = spark.createDataFrame([(1, 1), (2, 1)], "node long, root long")
    open_pairs = N._rooted(pairs, roots)
    assert sorted(tuple(r) for r in open_pairs.select("a", "b", "ra", "rb").collect()) == [(1, 5, 1, 5), (2, 5, 1, 5), (6, 7, 6, 7)]
    assert sorted(tuple(r) for r in N._alike(open_pairs).collect()) == [(2, 5), (6, 7)]


def test_sums_over_pieces_are_never_below_the_distance(spark, words):
    pairs = []
    for k in range(30):
        r, w = random.Random(k), words(k, 90).split()
        for _ in range(r.randrange(12)):
            i = r.randrange(len(w))
            w[i : i + r.randrange(3)] = ["x" * r.randrange(9)] * r.randrange(3)
        pairs.append((words(k, 90), " ".join(w) or "x"))
    df = spark.createDataFrame(pairs, "s string, t string").selectExpr("*", "length(s) AS ls", "length(t) AS lt", "length(s) AS most").withColumn("sum", N._by_pieces())
    for r in df.collect():
        assert r["sum"] >= levenshtein(r["s"], r["t"])


def planted_pairs(words, kinds=(("word", 0.05), ("word", 0.1), ("word", 0.15), ("letter", 0.02), ("letter", 0.05)), each=60):
    """(kind, rate, line, edited line) whose normal forms differ and have edit similarity of at least 0.8 by Levenshtein."""
    out = []
    for kind, rate in kinds:
        for k in range(each):
            r, s = random.Random(f"{kind} {rate} {k}"), words(f"{kind} {rate} {k}", [6, 12, 25, 50, 80][k % 5], 4000)
            cells = s.split() if kind == "word" else list(s)
            for i in r.sample(range(len(cells)), max(1, round(len(cells) * rate))):
                cells[i] = "".join(r.choice("etaoinshrdlu") for _ in cells[i])
            t = (" " if kind == "word" else "").join(cells)
            if plain_norm(s) != plain_norm(t) and similar_lines(plain_norm(s), plain_norm(t)):
                out.append((kind, rate, s, t))
    return out


def test_recall_of_planted_pairs(docs, words):
    """At least 0.9 of the pairs with changed words and of those with scattered letters, by Levenshtein alone."""
    pairs = planted_pairs(words)
    rows = [(2 * k + i, p[2 + i]) for k, p in enumerate(pairs) for i in range(2)]
    gone = {x["doc_id"] for x in N.line_dedup(docs(rows)).where("n_dropped = 1").collect()}
    for kind in ("word", "letter"):
        own = [k for k, p in enumerate(pairs) if p[0] == kind]
        found = sum(2 * k + 1 in gone for k in own) / len(own)
        print(kind, len(own), found)
        assert len(own) > 80 and found >= 0.9


def test_lines_of_one_edit_in_five_meet(docs, words):
    """All pairs by Levenshtein alone, over line pairs that differ in a word or in letters."""
    r = random.Random(8)
    pairs = []
    for k in range(40):
        w = words(7000 + k, [2, 3, 6, 12, 25][k % 5], 4000).split()
        w[r.randrange(len(w))] += "x" if k % 5 < 2 else "ab"
        pairs.append((words(7000 + k, [2, 3, 6, 12, 25][k % 5], 4000), " ".join(w)))
    rows = [(2 * k + i, x) for k, p in enumerate(pairs) for i, x in enumerate(p)]
    similar = [k for k, (s, t) in enumerate(pairs) if levenshtein(s, t) <= int(max(len(s), len(t)) * 0.2 + 1e-9)]
    dropped = {x["doc_id"] for x in N.line_dedup(docs(rows)).where("n_dropped = 1").collect()}
    assert len(similar) > 25 and [pairs[k] for k in similar if 2 * k + 1 not in dropped] == []


def test_lines_are_compared_without_the_tables_behind_them(docs, words, monkeypatch):
    """While pairs are compared, only the texts in buckets lie on disk, and no keys."""
    live, seen = {}, {}
    park, drop = N.parked, N.dropped

    def parked(df, name="table"):
        seen[name] = [c for columns in live.values() for c in columns]
        out = park(df, name)
        live.update(dict.fromkeys({f.rpartition("/")[0] for f in out.inputFiles()}, out.columns))
        return out

    def dropped(*frames):
        for f in {x.rpartition("/")[0] for df in frames for x in df.inputFiles()}:
            live.pop(f, None)
        drop(*frames)

    monkeypatch.setattr(N, "parked", parked)
    monkeypatch.setattr(N, "dropped", dropped)
    check_lines(docs, fuzzy(words, 1))
    for name in ("links", "more"):
        assert seen[name].count("norm") == 1
        assert "keys" not in seen[name]
    assert "bucket" not in seen["more"]
