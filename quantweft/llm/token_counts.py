"""Unigram token counts by trie-shared dynamic programming (operator 7).

A pre-token is cut into vocabulary pieces so that the sum of the pieces' unigram log-probabilities is highest (of
equal sums: fewest pieces).  The distinct pre-tokens of a slice of text form a trie, walked depth first; sorted
strings visit its nodes in that order, so only the current path is held.  The forward score of a node (a prefix) is
computed once and serves all pre-tokens below it; where a pre-token ends, its count is stored for reuse.

The vocabulary file has ranks, not probabilities; the probability of rank r is 1 / (r + SHIFT) over the sum of these, Zipf's law.
All single bytes are pieces, so every text can be cut.  Vocabulary and pattern are parameters.

No shuffle: one pass over the documents.  Per worker: the vocabulary, the kept counts (bounded), one slice of text.

Defined cases: null and empty text count 0 tokens and score 0; null doc_id stays null; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweft.llm import common as C
from quantweft.llm.bpe import read_ranks, slices, vocabulary

SHIFT = 2.7
KEPT, KEPT_LENGTH = 300_000, 64


class Unigram:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        whole = math.log(math.fsum(1 / (rank + SHIFT) for rank in ranks.values())) if ranks else 0.0
        self.score = {piece: -math.log(rank + SHIFT) - whole for piece, rank in ranks.items()}
        #: lengths of the pieces that end in each byte, shortest first
        ends: dict[int, set[int]] = {}
        for piece in ranks:
            ends.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {b: sorted(x) for b, x in ends.items()}
        self.find = regex.compile(pattern).findall
        self.kept: dict[str, tuple[int, float]] = {}

    def count_sorted(self, tokens: list[bytes]) -> list[tuple[int, float]]:
        """(pieces, score) of sorted distinct pre-tokens."""
        score, lengths = self.score, self.lengths
        best, pieces = [0.0], [0]  # of each prefix of the current path
        path = b""
        out = []
        for token in tokens:
            shared, top = 0, min(len(path), len(token))
            while shared < top and path[shared] == token[shared]:
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            for i in range(shared, len(token)):
                top_score, top_pieces = -math.inf, 0
                for n in lengths[token[i]]:
                    j = i + 1 - n
                    if j < 0:
                        break
                    s = score.get(token[j : i + 1])
                    if s is not None:
                        s += best[j]
                        if s > top_score or (s == top_score and pieces[j] + 1 < top_pieces):
                            top_score, top_pieces = s, pieces[j] + 1
                best.append(top_score)
                pieces.append(top_pieces)
            path = token
            out.append((pieces[-1], best[-1]))
        return out

    def count(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(pre-tokens, pieces, score) of each text."""
        split = [self.find(t) if t else [] for t in texts]
        kept = self.kept
        new = {t for tokens in split for t in tokens if t not in kept}
        if len(kept) + len(new) > KEPT:
            kept.clear()
            new = {t for tokens in split for t in tokens}
        coded = sorted((t.encode(), t) for t in new)
        kept.update(zip((t for _, t in coded), self.count_sorted([b for b, _ in coded]), strict=True))
        out = []
        for tokens in split:
            found = [kept[t] for t in tokens]
            out.append((len(tokens), sum(n for n, _ in found), math.fsum(s for _, s in found)))
        for t in new:
            if len(t) > KEPT_LENGTH:
                del kept[t]
        return out


#: Of this worker, by rank file and pattern.
_models: dict[tuple[str, str], Unigram] = {}


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, score) of every row of docs (doc_id, text)."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _models.get((ranks_path, pattern))
        if model is None:
            model = _models[ranks_path, pattern] = Unigram(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch):
                rows = model.count(part.column("text").to_pylist())
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["doc_id", "n_pretokens", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(C.table(spark, sf_dir, "documents"), *vocabulary())
