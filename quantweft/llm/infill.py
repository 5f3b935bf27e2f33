"""Fill-in-middle transformation with a sparse checkpoint index (operator 13).

A text is a run of units: code points, words (a word with the blanks before it; blanks at the end are one more) or lines
(with their line feed).  Counting the units records a checkpoint every STRIDE of them: how many units, bytes and code
points lie before it.  A cut after k units is found by binary search over the checkpoints and a rescan of fewer than
STRIDE units from there; the text is never expanded into an array of its characters.

The cuts follow from sha256("1:" + doc_id), so a document is cut alike on every run.  `order` of the parts:

* psm: <P> prefix <S> suffix <M> middle
* spm: <S> suffix <P> prefix <M> middle
* plain: the text itself, if it is empty or holds a marker, or by chance (1 - RATE)

No shuffle: one pass over the documents, one text at a time beside the Arrow batch.

Defined cases: null and empty text is a plain empty text of 0 units; a null doc_id stays null and is hashed like an
empty string; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweft.llm import common as C

PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
#: Percent of the texts that are transformed, and percent of these in the order spm.
RATE, SPM = 90, 20
STRIDE = 4096
#: Bytes that are counted at a time.
BLOCK = 1 << 20
UNITS = {"words": re.compile(rb"[\x09-\x0D\x20]*[^\x09-\x0D\x20]+|[\x09-\x0D\x20]+\Z"), "lines": re.compile(rb"[^\n]*\n|[^\n]+\Z")}


class Checkpoints:
    """Where every STRIDE-th unit of a text (UTF-8) begins."""

    def __init__(self, text: bytes | memoryview, unit: str = "chars", stride: int = STRIDE):
        self.text, self.unit, self.stride = text, unit, stride
        self.units, self.bytes, self.points = [0], [0], [0]
        self.n, self.n_points = (self._count_chars if unit == "chars" else self._count_matches)()

    def _starts(self, lo: int, hi: int) -> np.ndarray:
        """Offsets of the code points that begin in a part of the text."""
        return np.flatnonzero((np.frombuffer(self.text, np.uint8, hi - lo, lo) & 0xC0) != 0x80)

    def _add(self, units: int, at: int, points: int) -> None:
        self.units.append(units)
        self.bytes.append(at)
        self.points.append(points)

    def _count_chars(self) -> tuple[int, int]:
        n, size = 0, len(self.text)
        for lo in range(0, size, BLOCK):
            starts = self._starts(lo, min(size, lo + BLOCK))
            for i in range(-n % self.stride, len(starts), self.stride):
                if n + i:
                    self._add(n + i, lo + int(starts[i]), n + i)
            n += len(starts)
        return n, n

    def _count_matches(self) -> tuple[int, int]:
        n = points = last = 0
        for m in UNITS[self.unit].finditer(self.text):
            if n and n % self.stride == 0:
                points += len(self._starts(last, m.start()))
                last = m.start()
                self._add(n, last, points)
            n += 1
        return n, points + (len(self._starts(last, len(self.text))) if last < len(self.text) else 0)

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) before unit k."""
        if k >= self.n:
            return len(self.text), self.n_points
        i = bisect_right(self.units, k) - 1
        at, points, left = self.bytes[i], self.points[i], k - self.units[i]
        if not left:
            return at, points
        if self.unit == "chars":
            # a code point has four bytes at most
            return at + int(self._starts(at, min(len(self.text), at + 4 * (left + 1)))[left]), points + left
        for j, m in enumerate(UNITS[self.unit].finditer(self.text, at)):
            if j == left:
                return m.start(), points + len(self._starts(at, m.start()))
        raise AssertionError("the text has fewer units than were counted")


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))


def form_of(text: bytes, h3: int, h4: int, rate: int = RATE, spm: int = SPM) -> str:
    if not text or h3 % 100 >= rate or any(m.encode() in text for m in MARKERS):
        return "plain"
    return "spm" if h4 % 100 < spm else "psm"


def arranged(text: bytes, form: str, a: int, b: int) -> bytes:
    """The output of a text whose prefix ends before byte a and whose middle ends before byte b."""
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = (x.encode() for x in MARKERS)
    return {"plain": lambda: text, "psm": lambda: p + prefix + s + suffix + m + middle, "spm": lambda: s + suffix + p + prefix + m + middle}[form]()


def infill(docs: DataFrame, unit: str = "chars", rate: int = RATE, spm: int = SPM, stride: int = STRIDE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs (doc_id, text); n in units, lengths of
    the parts in code points, null if plain."""
    if unit not in ("chars", *UNITS):
        raise ValueError(f"unknown unit: {unit}")

    def one(doc_id: int | None, text: bytes) -> tuple:
        h1, h2, h3, h4 = draws(doc_id)
        index = Checkpoints(text, unit, stride)
        form = form_of(text, h3, h4, rate, spm)
        if form == "plain":
            return index.n, form, None, None, text
        (a, a_points), (b, b_points) = sorted(index.cut(h % (index.n + 1)) for h in (h1, h2))
        return index.n, form, a_points, b_points - a_points, arranged(text, form, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            rows, size, lo = [], 0, 0
            for i in range(batch.num_rows):
                rows.append(one(ids[i].as_py(), texts[i].as_py() or b""))
                size += len(rows[-1][-1])
                if size >= BLOCK or i == batch.num_rows - 1:
                    n, form, prefix, middle, output = zip(*rows, strict=True)
                    columns = [ids.slice(lo, len(rows)), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    rows, size, lo = [], 0, i + 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts in their first order."""

    def between(first: str, then: str | None) -> Column:
        begin = F.locate(first, output) + len(first)
        return F.substring(output, begin, F.locate(then, output) - begin if then else F.length(output))

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill(C.table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select *, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
k as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 % 100 >= {RATE} then 'plain' when h4 % 100 < {SPM} then 'spm' else 'psm' end as form from u),
o as (select *, substring(text, 1, a) as p, substring(text, a + 1, b - a) as m, substring(text, b + 1) as s from k)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m else '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m end) as output_sha256,
  sha256(text) as restored_sha256
from o
"""
