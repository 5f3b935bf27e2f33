r"""Source divergence audit with wide term vectors (operator 11).

Terms are runs of letters (everything but ASCII signs, digits and blanks), A-Z lower-cased.  A language keeps the V terms that at
least LEAST of its documents hold.  A group (language, source), or the language as a whole, gives a kept term with `count`
occurrences p = 1 + floor(SCALE * (count + 1) / (N + V)), N being the sum of its counts; the divergence of p from q is
floor((p - q)^2 / q).  All of it is integer arithmetic.

* Each kept term is one row: the language, the term and an array of (source index, count) of the sources that have it.
* Each two sources of an array are rows with what the two counts change, made in generated code; map-side aggregation sums
  that by pair.  A source without the term has the same p for all such terms: these parts follow from how often each count occurs
  in a source, so a term costs the square of the sources that hold it, not of all.
* Terms over the language's p are ranked by source; each task passes on its best RANKS of a source only.

Skew: terms are counted in the tasks before the first shuffle (bounded tables); a hot source or language is a longer scan, and no key
of a shuffle is a source or a language alone but for sums and short lists.  Memory: a row holds the sources of one term; the result has
a row for each two sources of a language, so a list of the sources of a language is smaller than the result.

Defined cases: null text, lang and source are ''; every row is a document, repeated ones too; groups without terms are there, with
value 0 if the language keeps no term; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweft.llm import common as C

SCALE = 1_000_000_000
LEAST, RANKS = 3, 200
#: SCALE * (count + 1) fits a long below this count.
MOST_COUNT = 9_000_000_000
#: Letters as they are, A-Z in lower case, all else a blank.
LETTERS = bytes(i if i >= 0x80 or 0x61 <= i <= 0x7A else i + 32 if 0x41 <= i <= 0x5A else 0x20 for i in range(256))
#: A task counts so many (language, source, term) at once before it passes them on.
KEPT = 600_000
#: Lists of sources are broadcast up to so many bytes.
MOST_BYTES = 32 << 20


def term_counts(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it."""

    def flush(tables: dict) -> Iterator[pa.RecordBatch]:
        langs, sources, terms, n, d = [], [], [], [], []
        for (lang, source), (count, within) in tables.items():
            langs += [lang] * len(count)
            sources += [source] * len(count)
            terms += count.keys()
            n += count.values()
            d += map(within.__getitem__, count)
        step = 50_000
        for lo in range(0, len(terms), step):
            part = slice(lo, lo + step)
            columns = [pa.array(langs[part]), pa.array(sources[part]), pa.array(terms[part], pa.binary()).cast(pa.string()), pa.array(n[part], pa.int64()), pa.array(d[part], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            lang, source, text = batch.columns
            for key, t in zip(zip(lang.to_pylist(), source.to_pylist(), strict=True), text.cast(pa.binary()), strict=True):
                words = (t.as_py() or b"").translate(LETTERS).split()
                count, within = tables.setdefault(key, (Counter(), Counter()))
                before = len(count)
                count.update(words)
                within.update(set(words))
                size += len(count) - before
                if size >= kept:
                    yield from flush(tables)
                    tables, size = {}, 0
        yield from flush(tables)

    rows = _plain(docs).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], "text")


def _p(count: str, total: str) -> str:
    """SQL of p; in decimals where SCALE * count would exceed a long."""
    wide = f"(cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div cast({total} as decimal(20,0))"
    return f"(1L + if({count} < {MOST_COUNT}L, ({SCALE}L * ({count} + 1L)) div {total}, {wide}))"


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


class Audit:
    """The written vectors and the sources of each language."""

    def __init__(self, docs: DataFrame, least: int = LEAST, kept: int = KEPT):
        sources = _plain(docs).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("names"))
        sources = C.materialize(sources, "sources")
        self._small = self._bounded(sources)
        index = sources.select("lang", F.posexplode("names").alias("i", "source"))
        # written, so that the shuffle of the counts is over and its files go before the next
        counts = C.materialize(term_counts(docs, kept), "counts")
        counts = counts.join(self._sent(index), ["lang", "source"])
        vectors = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("i", "n")).alias("vector"))
        #: (lang, term, n, vector: array<struct<i, n>>) of the kept terms
        self.vectors = C.materialize(vectors.filter(F.col("docs") >= least).drop("docs"), "vectors")
        entries = self.vectors.select("lang", F.explode("vector").alias("e")).select("lang", "e.i", "e.n")
        #: (lang, i, n, terms): how many kept terms have n occurrences in source i
        self.histogram = C.materialize(entries.groupBy("lang", "i", "n").agg(F.count(F.lit(1)).alias("terms")), "histogram")
        by_source = self.histogram.groupBy("lang", "i").agg(F.sum(F.col("n") * F.col("terms")).alias("n"), F.sum("terms").alias("terms"))
        kept_terms = self.vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
        rows = index.join(by_source, ["lang", "i"], "left").join(kept_terms, "lang", "left").na.fill(0, ["n", "terms", "v"])
        # nothing is divided where a language keeps no term, but the expressions are evaluated
        rows = rows.withColumn("total", F.greatest(F.col("n") + F.col("v"), F.lit(1)))
        item = F.struct("i", "source", "terms", "total", F.expr(_p("0", "total")).alias("zero"))
        langs = rows.groupBy("lang").agg(F.max("v").alias("v"), F.greatest(F.sum("n") + F.max("v"), F.lit(1)).alias("total"), F.sort_array(F.collect_list(item)).alias("of"))
        #: (lang, v, total, of: array<struct<i, source, terms, total, zero>> by i)
        self.langs = C.materialize(langs, "langs")

    @staticmethod
    def _bounded(sources: DataFrame) -> bool:
        size = sources.agg(F.sum(F.expr("size(names) * 64L + aggregate(names, 0L, (a, x) -> a + octet_length(x))"))).first()[0]
        return (size or 0) <= MOST_BYTES

    def _sent(self, lists: DataFrame) -> DataFrame:
        return F.broadcast(lists) if self._small else lists

    def pairs(self) -> DataFrame:
        """(lang, i, j, value) of each two sources of a language."""
        langs = self._sent(self.langs.select("lang", "v", "of"))
        entry = f"struct(e.i as i, {_p('e.n', 'get(of, e.i).total')} as p, get(of, e.i).zero as z)"
        change = f"{_f('a.p', 'b.p')} - {_f('a.p', 'b.z')} - {_f('a.z', 'b.p')} + {_f('a.z', 'b.z')}"
        wide = self.vectors.filter("size(vector) > 1").join(langs, "lang").select("lang", F.expr(f"transform(vector, e -> {entry})").alias("vector"))
        # two explodes and a sum of their own, in generated code: a lambda is interpreted, and this runs for each two sources of a term.
        # No vector is empty; outer, because Spark would else test the vectors first, which computes them again
        one = wide.select("lang", "vector", F.explode_outer("vector").alias("a"))
        two = one.select("lang", "a", F.explode_outer("vector").alias("b")).filter("a.i <> b.i")
        both = two.groupBy("lang", F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.expr(change)).alias("value"))
        # one of the two sources lacks the term
        seen = self.histogram.join(langs, "lang").select("lang", "i", "terms", "of", F.expr(_p("n", "get(of, i).total")).alias("p"))
        others = f"array(struct(i as i, b.i as j, terms * {_f('p', 'b.zero')} as value), struct(b.i as i, i as j, terms * {_f('b.zero', 'p')} as value))"
        lone = seen.select("lang", F.explode(F.expr(f"flatten(transform(filter(of, b -> b.i <> i), b -> {others}))")).alias("x")).select("lang", "x.*")
        # both lack it
        each = langs.select("lang", "v", "of", F.explode("of").alias("a"))
        none = F.expr(f"transform(filter(of, b -> b.i <> a.i), b -> struct(a.i as i, b.i as j, (v - a.terms - b.terms) * {_f('a.zero', 'b.zero')} as value))")
        neither = each.select("lang", F.explode(none).alias("x")).select("lang", "x.*")
        return both.unionByName(lone).unionByName(neither).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))

    def terms(self, ranks: int = RANKS) -> DataFrame:
        """(lang, i, term, value, rank): the terms that a source has more of than its language, the most divergent first."""
        wide = self.vectors.join(self._sent(self.langs.select("lang", F.col("total").alias("all"), "of")), "lang")
        wide = wide.select("lang", "term", F.expr(_p("n", "all")).alias("q"), F.expr(f"transform(vector, e -> struct(e.i as i, {_p('e.n', 'get(of, e.i).total')} as p))").alias("vector"))
        over = F.expr(f"transform(filter(vector, e -> e.p > q), e -> struct(e.i as i, {_f('e.p', 'q')} as value))")
        rows = wide.select("lang", "term", F.explode(over).alias("x")).select("lang", "x.i", "term", "x.value")
        return rows.withColumn("rank", F.expr("row_number() over (partition by lang, i order by value desc, term)")).filter(F.col("rank") <= ranks)

    def result(self, ranks: int = RANKS) -> DataFrame:
        """(lang, source, part, item, value, rank), parts pair and term."""
        named = self._sent(self.langs.select("lang", "of"))
        pairs = self.pairs().join(named, "lang").select("lang", "i", F.expr("get(of, i).source").alias("source"), F.lit("pair").alias("part"), F.expr("get(of, j).source").alias("item"), "value")
        pairs = pairs.withColumn("rank", F.expr("row_number() over (partition by lang, i order by value desc, item)"))
        terms = self.terms(ranks).join(named, "lang").select("lang", F.expr("get(of, i).source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
        return pairs.drop("i").unionByName(terms)


def divergence(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    with C.scratch() as kept:
        return kept(C.materialize(Audit(docs, least).result(ranks), "divergence"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(C.table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
g as (select distinct lang, source from d),
k as (select lang, term from (select lang, unnest(list_distinct(w)) as term from d) group by all having count(*) >= {LEAST}),
v as (select g.lang, count(distinct k.term) as v from (select distinct lang from g) g left join k using (lang) group by g.lang),
o as (select lang, source, term, count(*) as n from (select lang, source, unnest(w) as term from d) group by all),
c as (select g.lang, g.source, k.term, coalesce(o.n, 0) as n from g join k using (lang) left join o on o.lang = g.lang and o.source = g.source and o.term = k.term),
p as (select lang, source, term, n, 1 + (cast({SCALE} as hugeint) * (n + 1)) // (sum(n) over (partition by lang, source) + v) as p from c join v using (lang)),
l as (select lang, term, sum(n) as n from c group by all),
q as (select lang, term, 1 + (cast({SCALE} as hugeint) * (n + 1)) // (sum(n) over (partition by lang) + v) as q from l join v using (lang)),
f as (select a.lang, a.source, b.source as item, cast(sum((a.p - b.p) * (a.p - b.p) // b.p) as bigint) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
term as (select p.lang, p.source, 'term' as part, p.term as item, cast((p - q) * (p - q) // q as bigint) as value from p join q using (lang, term) where n > 0 and p > q),
r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from (select * from pair union all select * from term))
select * from r where part = 'pair' or rank <= {RANKS}
"""
