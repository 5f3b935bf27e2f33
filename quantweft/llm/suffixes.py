"""Substring dedup of bytes by deep-shallow suffix sorting (operator 10).

A byte goes when a 200-byte string that covers it starts at another place too.  Suffixes are grouped by anchors, 32-byte seeds
(`repeats`): equal suffixes, copies of one context around a seed, are one leaf with a count, after a digest of the source
bytes at each place has shown that they are equal.  The distinct contexts of a seed are sorted: their suffixes from the seed
on by multikey quicksort down to SHALLOW bytes past the seed, then by a blind trie for the groups that still
agree.  The texts before the seed are sorted likewise, read backwards.  The longest common prefixes of both orders give,
for each context, all windows it shares with any other: suffix intervals merge from the longest prefix down, and in the
merged set only neighbours of the backward order can share more to the left.  That is m log m, not all pairs.

A hot seed, of more than GROUP distinct contexts, is split over tasks further down the order, where suffixes agree in a
whole window: each window is a group of its own, named by 128 bits of hash.  Windows that several contexts in one task hold
are settled there, and one of them is sent on.  Both ways give all shared windows.

Defined cases: null text is empty; repeated rows are places of their own, so all they hold goes; an empty table gives an
empty result; null doc_ids stay null; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweft.llm import common as C
from quantweft.llm import kernels as K
from quantweft.llm import repeats as R

SIZE, SEED = 200, 32
SHALLOW = 16
GROUP = 500


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, step = 0, 16
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    while step > 1:
        step >>= 1
        if a[lo : lo + step] == b[lo : lo + step]:
            lo += step
    return lo


class Leaf(list):
    """Indices of equal strings."""


class Fork:
    """An inner node: strings below agree up to `depth` and differ in the byte there (-1: the string ends)."""

    __slots__ = ("depth", "below")

    def __init__(self, depth: int, below: dict):
        self.depth, self.below = depth, below


def blind_trie(strings: list[bytes], which: list[int]) -> list[int]:
    """The indices in the order of their strings; equal strings in the order given."""
    root: Leaf | Fork = Leaf([which[0]])
    for i in which[1:]:
        s = strings[i]
        byte = lambda d, s=s: s[d] if d < len(s) else -1
        forks, node = [], root
        while isinstance(node, Fork):  # blind: looks at branching bytes only
            forks.append(node)
            node = node.below.get(byte(node.depth)) or next(iter(node.below.values()))
        other = strings[node[0]]
        n = common_prefix(s, other)
        if n == len(s) == len(other):
            node.append(i)
            continue
        parent, child = None, root
        for fork in forks:  # down again, to where s leaves the trie
            child = fork
            if fork.depth >= n:
                break
            parent, child = fork, fork.below[byte(fork.depth)]
        if isinstance(child, Fork) and child.depth == n:
            child.below[byte(n)] = Leaf([i])
            continue
        fork = Fork(n, {(other[n] if n < len(other) else -1): child, byte(n): Leaf([i])})
        if parent is None:
            root = fork
        else:
            parent.below[byte(parent.depth)] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, Fork):
            stack.extend(node.below[k] for k in sorted(node.below, reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> list[int]:
    """The order of strings that agree in their first `depth` bytes."""
    out: list[int] = []
    stack = [(list(range(len(strings))), depth)]
    while stack:
        which, d = stack.pop()
        if len(which) <= 1:
            out.extend(which)
            continue
        if d >= depth + shallow or len(which) == 2:
            out.extend(blind_trie(strings, which))
            continue
        byte = [strings[i][d] if d < len(strings[i]) else -1 for i in which]
        pivot = sorted((byte[0], byte[len(byte) // 2], byte[-1]))[1]
        less, same, more = ([i for i, x in zip(which, byte, strict=True) if keep(x)] for keep in (pivot.__gt__, pivot.__eq__, pivot.__lt__))
        stack.append((more, d))
        if pivot < 0:
            stack.append((same, depth + shallow))
        else:
            stack.append((same, d + 1))
        stack.append((less, d))
    return out


def shared_windows(contexts: list[bytes], seeds: list[int], size: int, k: int) -> list[list[tuple[int, int]]]:
    """For each distinct context with its seed (k bytes) at the given offset: ranges (a, b) of the starts of windows
    of `size` bytes around the seed that another context holds too."""
    m = len(contexts)
    found: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    right = [c[o:] for c, o in zip(contexts, seeds, strict=True)]
    left = [c[:o][::-1] for c, o in zip(contexts, seeds, strict=True)]

    def note(x: int, y: int, r: int) -> None:
        n = common_prefix(left[x], left[y])
        if n + r >= size:
            found[x].append((seeds[x] - n, seeds[x] + r - size))
            found[y].append((seeds[y] - n, seeds[y] + r - size))

    if m == 2:
        note(0, 1, common_prefix(right[0], right[1]))
        return found
    order = deep_shallow(right, k if len({r[:k] for r in right}) == 1 else 0)  # seeds of one hash are one string
    rank = [0] * m
    for i, x in enumerate(deep_shallow(left)):
        rank[x] = i
    back = [0] * m
    for x, i in enumerate(rank):
        back[i] = x
    lcp = [common_prefix(right[order[i]], right[order[i + 1]]) for i in range(m - 1)]
    member = list(range(m))  # of each place in `order`: its set, a sorted list of backward ranks
    sets: dict[int, list[int]] = {i: [rank[x]] for i, x in enumerate(order)}

    def find(i: int) -> int:
        while member[i] != i:
            member[i] = member[member[i]]
            i = member[i]
        return i

    for i in sorted(range(m - 1), key=lcp.__getitem__, reverse=True):
        a, b, r = find(i), find(i + 1), lcp[i]
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large = sets[a]
        for y in sets.pop(b):
            at = bisect_left(large, y)
            if at:
                note(back[large[at - 1]], back[y], r)
            if at < len(large):
                note(back[large[at]], back[y], r)
            large.insert(at, y)
        member[b] = a
    return found


CONTEXTS = "node long, doc_id long, lo long, off long, c long, context binary, h1 long, h2 long, at long, n long, more boolean"


def combined(w: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...]]:
    """(windows with `more`, (doc_id, lo, n) of those that repeat among them): of windows at several places here one is left."""
    order = np.lexsort((w["h2"], w["h1"]))
    h1, h2 = w["h1"][order], w["h2"][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    kind = np.cumsum(new) - 1
    often = np.bincount(kind, minlength=1)[kind] > 1 if len(kind) else new
    left = order[new]
    rest = {c: x[left] for c, x in w.items()} | {"more": often[new]}
    known = order[often]
    known = known[np.lexsort((w["at"][known], w["doc_id"][known]))]
    doc, at = w["doc_id"][known], w["at"][known]
    first = np.ones(len(at), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(first)
    return rest, (doc[begin], at[begin], np.diff(np.append(begin, len(at))))


def contexts_of(unit: R.Unit, group: int):
    """For read_places: CONTEXTS of heads; those of hot seeds as windows (context is null)."""

    def look(chunk: K.Chunk, ids: np.ndarray, row: np.ndarray, f: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        hot = f["m"] > group
        cold = {x: v[~hot] for x, v in f.items()}
        data, start, stop = chunk.buf.tobytes(), chunk.offsets[row[~hot]], chunk.offsets[row[~hot] + 1]
        begin = start + cold["lo"]
        end = np.minimum(begin + cold["n"] + unit.size - 1, stop)
        context = [data[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
        windows, known = combined(R.window_hashes(chunk, ids, row[hot], {x: v[hot] for x, v in f.items()}, unit))
        sizes = len(context), len(windows["h1"]), len(known[0])

        def column(kind: pa.DataType, *parts) -> pa.Array:
            return pa.concat_arrays([pa.nulls(n, kind) if x is None else pa.array(x, kind) for x, n in zip(parts, sizes, strict=True)])

        long = pa.int64()
        out = {x: column(long, cold[x], None, None) for x in ("node", "off", "c")} | {x: column(long, None, windows[x], None) for x in ("h1", "h2", "at")}
        out |= {"doc_id": column(long, ids[row[~hot]], windows["doc_id"], known[0]), "lo": column(long, cold["lo"], None, known[1]), "n": column(long, None, None, known[2])}
        out |= {"context": column(pa.binary(), context, None, None), "more": column(pa.bool_(), None, windows["more"], None)}
        return out

    return look


def sorted_groups(contexts: DataFrame, size: int, k: int) -> DataFrame:
    """(doc_id, lo, n): window ranges that two contexts of a seed share, of contexts with one place; a seed has GROUP at most."""

    def group(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        if len(rows) < 2 or all(r[4] > 1 for r in rows):
            return
        for (_, doc, lo, _, c, _), ranges in zip(rows, shared_windows([r[5] for r in rows], [r[3] for r in rows], size, k), strict=True):
            if c == 1:
                for a, b in set(ranges):
                    yield doc, lo + a, b - a + 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("node", "doc_id", "lo", "off", "c", "context")), strict=True):
                if held and held[0][0] != row[0]:
                    out.extend(group(held))
                    held = []
                held.append(row)
            yield _ranges(out)
        yield _ranges(list(group(held)))

    placed = contexts.repartition("node").sortWithinPartitions("node")
    return placed.mapInArrow(read, "doc_id long, lo long, n long")


def _ranges(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    doc, lo, n = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "lo", "n"])


def dedup_bytes(docs: DataFrame, size: int = SIZE, seed: int = SEED, group: int = GROUP, bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): each text without the bytes of strings that occur twice."""
    rows, names = C.keyed(docs)
    unit = R.Unit(False, size, seed, bits)
    with C.scratch() as kept:
        found = R.graph(rows, unit)
        places = R.read_places(rows, found.spans, found.heads, unit, ("node", "off", "c", "m"), contexts_of(unit, group), CONTEXTS)
        contexts = places.filter("context is not null").select("node", "doc_id", "lo", "off", "c", "context")
        windows = places.filter("h1 is not null").select("h1", "h2", "doc_id", "at", "more")
        known = places.filter("n is not null").select("doc_id", "lo", "n")
        gone, more = R.verified(found, places, rows, unit)
        windows = windows if more is None else windows.unionByName(more.withColumn("more", F.lit(False)))
        gone = gone.select("doc_id", "lo", "n").unionByName(known).unionByName(sorted_groups(contexts, size, seed)).unionByName(R.repeated_windows(windows, keep_first=False))
        gone = kept(C.materialize(gone, "gone"))

    def rewrite(text: bytes, lo: np.ndarray, n: np.ndarray) -> tuple:
        if not len(lo):
            return len(text), 0, 0, text
        out = R.covered(lo, n, size, len(text))
        spans = int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1]))
        kept = np.frombuffer(text, np.uint8)[~out].tobytes()
        return len(text), len(text) - len(kept), spans, kept

    out = R.rewritten(rows, gone, rewrite, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return C.named(out, names)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
