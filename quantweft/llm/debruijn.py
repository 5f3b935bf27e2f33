"""Substring dedup of words by De Bruijn compaction (operator 2).

Word 5-grams at anchor positions are the edges of a sparse de Bruijn graph (`repeats`); what follows an edge gives its in- and
out-degree.  Links that do not branch compact, by pointer-jumping joins, to one span each.  Source coordinates (doc_id,
word) say which place of a span is the first and stays; each later place is verified by a digest of its own words
in the source text and then loses all windows at once.  At forks, where an edge has several paths, each distinct path is taken
once, at its first place, and its windows are compared by 128-bit hashes, each half from the bytes of the words.

Defined cases: null text has no words; null doc_ids come before all others; rows that repeat an id and its text count
as one document and give a row each; different texts of one id are documents of their own, in the order of their sha256; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweft.llm import common as C
from quantweft.llm import repeats as R

SIZE, ANCHOR = 20, 5


def dedup_words(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text's words but those of windows that started earlier elsewhere."""
    rows, names = C.keyed(docs)
    unit = R.Unit(True, size, anchor, bits)
    with C.scratch() as kept:
        found = R.graph(rows, unit)
        places = R.read_places(rows, found.spans, found.heads, unit, (), R.WindowsOf(unit), R.WINDOWS)
        windows = places.filter("digest is null").select("h1", "h2", "doc_id", "at")
        spans, more = R.verified(found, places, rows, unit)
        windows = windows if more is None else windows.unionByName(more)
        gone = spans.filter("not first")
        gone = kept(C.materialize(gone.select("doc_id", "lo", "n").unionByName(R.repeated_windows(windows, keep_first=True)), "gone"))

    def rewrite(text: bytes, lo: np.ndarray, n: np.ndarray) -> tuple:
        words = text.split()
        if not len(lo):
            return len(words), 0, b" ".join(words).decode()
        out = R.covered(lo, n, size, len(words))
        kept = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
        return len(words), len(words) - len(kept), b" ".join(kept).decode()

    out = R.rewritten(rows, gone, rewrite, "doc_id long, n_words long, n_removed long, kept string")
    return C.named(out, names)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_words(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
with w as materialized (
  select doc_id, i, words[i] as word, array_to_string(words[i:i+19], ' ') as win, i + 19 <= len(words) as whole
  from (select doc_id, words, unnest(range(1, len(words) + 1)) as i
        from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents))),
f as (select doc_id, i, row_number() over (partition by win order by doc_id, i) > 1 as later from w where whole),
c as (select w.doc_id, w.i, w.word,
        max(coalesce(f.later, false)::int) over (partition by w.doc_id order by w.i rows between 19 preceding and current row) as gone
      from w left join f on w.doc_id = f.doc_id and w.i = f.i),
s as (select doc_id, count(*) as n_words, sum(gone)::bigint as n_removed, coalesce(string_agg(word, ' ' order by i) filter (gone = 0), '') as kept
      from c group by doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join s on d.doc_id = s.doc_id
"""
