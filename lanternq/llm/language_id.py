"""Language identification by cross-parsing entropy.

For each language, a suffix automaton holds every substring of a sample of its labelled texts. A text is parsed greedily into the longest phrases that
the automaton has; the fewer phrases a text needs, relative to its length, the closer it is to the language. The normalised count is
phrases * log2(sample length) / length, an estimate of cross-entropy in bits per character, and the smallest wins (ties: the language that sorts first).

Texts are parsed whole, from the first character to the last: letters in lower case, everything else one blank. All texts of a portion and all languages move in step
through one transition table in numpy. A missing transition is stored as the transition from the start with a flag, so that a step is one look-up; flags count phrases.
The table is dense for the DENSE letters that are most frequent in the samples; transitions by other letters of the samples are looked up in a sorted list, so that scripts of any size
are told apart letter by letter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 4, 2
#: A language's sample: from about so many rows, of each text the first so many characters at most, so many characters in total.
SAMPLE_ROWS, SAMPLE_TEXT, SAMPLE_CHARS = 64, 4096, 24_000
#: More languages than this are an error.
MOST_LANGUAGES = 200
DENSE = 62
#: Characters parsed together.
PORTION = 1 << 22
FLAG = np.int32(1 << 30)


def folded(text: str) -> np.ndarray:
    """Code points in lower case, every run of characters that are not letters as one 32."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[np.minimum(points, 0x10FFFF)], points, np.uint32(32))
    return points[(points != 32) | (np.concatenate((np.array([32], np.uint32), points[:-1])) != 32)]


_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _table:
        _table.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _table[0]


class Automaton:
    """Suffix automaton of a sequence of codes; ``rows`` has the transitions of each state."""

    def __init__(self, codes: list[int]):
        n = 2 * len(codes) + 2
        link, length = [-1] * n, [0] * n
        states, last = 1, 0
        rows: list[dict[int, int]] = [{}]
        for c in codes:
            new, states = states, states + 1
            length[new] = length[last] + 1
            rows.append({})
            p = last
            while p >= 0 and c not in rows[p]:
                rows[p][c] = new
                p = link[p]
            if p < 0:
                link[new] = 0
            else:
                q = rows[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone, states = states, states + 1
                    length[clone], link[clone] = length[p] + 1, link[q]
                    rows.append(dict(rows[q]))
                    link[q] = link[new] = clone
                    while p >= 0 and rows[p].get(c) == q:
                        rows[p][c] = clone
                        p = link[p]
            last = new
        self.rows = rows


class Parser:
    """Automata of several languages, laid out as one table. Code 0 is a blank, 1 any letter that no sample has, then come the letters of the samples, the most frequent first; codes of ``size`` and over are not in the table but in ``rare``."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = {k: np.concatenate([folded(t + " ") for t in samples[k]] or [np.zeros(0, np.uint32)])[:SAMPLE_CHARS] for k in self.languages}
        points, counts = np.unique(np.concatenate([*texts.values(), np.zeros(0, np.uint32)]), return_counts=True)
        usual = [p for _, p in sorted((-int(n), int(p)) for p, n in zip(points, counts, strict=True) if p != 32)]
        self.codes = np.ones(0x110000, np.int32)
        self.codes[32] = 0
        self.codes[usual] = np.arange(2, len(usual) + 2)
        self.size, self.all = min(len(usual), DENSE) + 2, len(usual) + 2
        self.rates = np.array([math.log2(max(2, len(texts[k]))) for k in self.languages])
        tables, rare, self.roots, self.closed, at = [], {}, [], [], 0
        for k in self.languages:
            rows = Automaton(self.codes[texts[k]].tolist()).rows
            table = np.full((len(rows), self.size), -1, np.int32)
            for i, row in enumerate(rows):
                for c, to in row.items():
                    if c < self.size:
                        table[i, c] = to
                    else:
                        rare[(at + i) * self.all + c] = at + to
            # A letter that the sample lacks is a phrase of its own; the last row is where it leads, and whatever follows begins a phrase.
            known, closed = table[0] >= 0, at + len(table)
            again = np.where(known, table[0] + at, closed)
            filled = np.where(table < 0, again | FLAG, table + at)
            filled[0] = again
            tables.append(np.vstack((filled, again | FLAG)).astype(np.int32))
            self.roots.append(at)
            self.closed.append(closed)
            at = closed + 1
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.keys = np.array(sorted(rare), np.int64)
        self.targets = np.array([rare[x] for x in sorted(rare)], np.int32)

    def _rare(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Where codes that are not in the table lead from states (languages, texts)."""

        def look(keys: np.ndarray) -> np.ndarray:
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            return np.where(self.keys[found] == keys, self.targets[found], -1)

        roots = np.array(self.roots, np.int64)[:, None]
        to, first = look(state.astype(np.int64) * self.all + codes), look(roots * self.all + codes)
        first = np.where(first < 0, np.array(self.closed, np.int32)[:, None], first)
        return np.where(to >= 0, to, np.where(state == roots, first, first | FLAG))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each folded text (rows) in each language (columns)."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        sizes = np.array([len(x) for x in texts], np.int64)
        if not sizes.sum() or not self.languages:
            return out
        whole = self.codes[np.concatenate(texts)]
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        begin, length = begin[order], sizes[order]
        steps = int(length[0])
        active = np.searchsorted(-length, -np.arange(steps), "left")  # texts longer than the step
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(order), 1)
        count = np.ones((len(self.languages), len(order)), np.int64)
        sparse = bool(len(self.keys))
        for j in range(steps):
            n = int(active[j])
            codes = whole[begin[:n] + j]
            if sparse and (odd := np.flatnonzero(codes >= self.size)).size:
                usual = np.where(codes < self.size, codes, 0)
                to = self.table[state[:, :n] * np.int32(self.size) + usual]
                to[:, odd] = self._rare(state[:, odd], codes[odd])
            else:
                to = self.table[state[:, :n] * np.int32(self.size) + codes]
            count[:, :n] += to >= FLAG
            state[:, :n] = to & (FLAG - 1)
        out[order] = count.T
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is how far the runner-up is behind, 1 where nothing competes."""
        split = [folded(t or "") for t in texts]
        counts = self.phrases(split)
        out = []
        for codes, row in zip(split, counts, strict=True):
            if not self.languages or not (codes != 32).any():
                out.append(("und", 0.0))
                continue
            bits = row * self.rates / len(codes)
            order = np.argsort(bits, kind="stable")
            best = bits[order[0]]
            out.append((self.languages[order[0]], float(1 - best / bits[order[1]]) if len(order) > 1 else 1.0))
        return out


def samples(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Bounded samples of labelled rows outside the held-out fold, by the smallest hashes of the id."""
    fold = F.crc32(F.col(id_col).cast("string")) % FOLDS
    known = docs.select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, SAMPLE_TEXT).alias("text"), F.xxhash64(id_col).alias("order"), F.shiftrightunsigned(F.xxhash64(id_col), 33).alias("draw")).where(
        F.col(id_col).isNotNull() & (fold != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    below = F.lit(0).cast("long")
    for r in counts:
        below = F.when(F.col("lang") == r["lang"], int(min(1.0, SAMPLE_ROWS / r["n"]) * (1 << 31))).otherwise(below)
    rows = known.where(F.col("draw") < below).select("lang", "text", "order").toPandas().sort_values(["order", "text"])
    out: dict[str, list[str]] = {}
    for r in counts:
        out[r["lang"]], total = [], 0
        for t in rows["text"][rows["lang"] == r["lang"]]:
            if total < SAMPLE_CHARS:
                out[r["lang"]].append(t)
                total += len(t)
    return {k: v for k, v in out.items() if v}


_parsers: dict[str, Parser] = {}


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns only from rows with a language whose crc32(id as text) mod 4 is not 2. Texts that are null or have no letter are ``und`` with score 0, and so is all if
    nothing can be learned. Repeated rows are each predicted; a null id is neither held out nor learned from. A prediction sees the text alone.
    """
    learned = samples(docs, id_col, text_col, lang_col)
    name = repr(sorted(learned.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _parsers:
            _parsers.clear()
            _parsers[name] = Parser(learned)
        parser = _parsers[name]
        for b in batches:
            texts, begin, total = b.column(2).to_pylist(), 0, 0
            for i, t in enumerate([*texts, None], 1):
                total += len(t or "")
                if total >= PORTION or i > len(texts):
                    found = parser.predict(texts[begin:i])
                    part = b.slice(begin, i - begin)
                    yield pa.record_batch([part.column(0), part.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
                    begin, total = i, 0

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
