"""Token counts of a unigram vocabulary by dynamic programming over a trie.

A text's pre-tokens are its runs of ``[^\\x20\\x09-\\x0D]+``, each with the word mark in front. The best segmentation of a pre-token maximises the
sum of its pieces' scores (on equal sums it has the fewest pieces); its forward score up to a character depends on nothing
after it. The distinct pre-tokens therefore go into a trie whose nodes hold the forward score of the prefix that leads to them: a pre-token
walks down the nodes that are there and scores only the characters beyond. The count at its end is stored, and counts of documents are sums of stored counts.

Each Python worker keeps its trie and the stored counts for all partitions that it works on, and begins anew beyond NODES nodes or CACHE_WORDS counts, so
that its memory is bounded; results do not depend on that. Nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: A character without a piece falls back to its UTF-8 bytes, each a token this much below the rarest piece.
BYTE_PENALTY = 10.0
CACHE_WORDS, NODES = 400_000, 1_000_000
SLICE = 512


class Unigram:
    """Pieces and scores of a SentencePiece vocabulary file. Scores there are ranks (of merges); as log-probabilities they follow Zipf's law."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        order = sorted(usual, key=lambda i: (-model.get_score(i), i))
        mass = math.log(sum(1 / r for r in range(1, len(order) + 1)))
        self.scores = {model.id_to_piece(i): -math.log(r) - mass for r, i in enumerate(order, 1)}
        self.byte = min(self.scores.values(), default=0.0) - BYTE_PENALTY
        lengths: dict[str, set[int]] = {}
        for piece in self.scores:
            lengths.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: sorted(x) for c, x in lengths.items()}


class Trie:
    """Prefixes of pre-tokens met so far. Node 0 is the empty prefix; a child is found by its parent and the character that leads to it."""

    def __init__(self, model: Unigram):
        self.model = model
        self.child: dict[int, int] = {}
        self.forward, self.tokens = [0.0], [0]

    def count(self, word: str) -> int:
        """Tokens of the best segmentation of a pre-token (without the mark)."""
        child, forward, tokens = self.child, self.forward, self.tokens
        scores, lengths, byte = self.model.scores, self.model.lengths, self.model.byte
        text, node, way = MARK + word, 0, [0]
        for end, last in enumerate(text, 1):
            key = node << 21 | ord(last)
            node = child.get(key, 0)
            if not node:
                best, fewest = -math.inf, 0
                for size in lengths.get(last, ()):
                    if size > end:
                        break
                    score = scores.get(text[end - size : end])
                    if score is not None:
                        before = way[end - size]
                        total, n = forward[before] + score, tokens[before] + 1
                        if total > best or (total == best and n < fewest):
                            best, fewest = total, n
                if last not in scores:
                    width = len(last.encode("utf-8", "surrogatepass"))
                    total, n = forward[way[end - 1]] + width * byte, tokens[way[end - 1]] + width
                    if total > best or (total == best and n < fewest):
                        best, fewest = total, n
                node = child[key] = len(forward)
                forward.append(best)
                tokens.append(fewest)
            way.append(node)
        return tokens[node]


class Counter:
    """Stored counts of pre-tokens, as bytes. Bytes that are not UTF-8 count as replacement characters."""

    def __init__(self, model: Unigram):
        self.model, self.trie, self.known = model, Trie(model), {}

    def counts(self, split: list[list[bytes]]) -> list[int]:
        """Tokens of each list of pre-tokens."""
        fresh = set().union(*split).difference(self.known)
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known.clear()
            fresh = set().union(*split)
        for w in fresh:
            if len(self.trie.forward) > NODES:
                self.trie = Trie(self.model)
            self.known[w] = self.trie.count(w.decode("utf-8", "replace"))
        return [sum(map(self.known.__getitem__, s)) for s in split]


_counters: dict[str, Counter] = {}


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(Unigram(path))
        counter = _counters[path]
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                split = [(x or b"").split() for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(list(map(len, split)), pa.int64()), pa.array(counter.counts(split), pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_pretokens, n_tokens.

    Null and empty texts have 0 of both; bytes that are not UTF-8 count as replacement characters. ``vocabulary`` is a path that executors can read too. Repeated rows are counted each, null ids are kept,
    other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_counter(vocabulary), "doc_id long, n_pretokens long, n_tokens long")
