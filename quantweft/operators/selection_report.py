"""How optimistic a choice of the best candidate is: a report for each pool of candidates, of any size and number.

No pool is gathered or sorted in one task: medians come from narrowing, ranks from a placement of all rows, the rest from aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantweft.operators import selection as Q
from quantweft.operators import windows as X
from quantweft.sources.staging import written


def _candidates(rows: DataFrame, by: list[str], item: str, score: str, pooled: str, size: str) -> DataFrame:
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return rows.select(F.struct(*by).alias("_g"), F.col(item).alias("_item"), known(score).alias("_score"), known(pooled).alias("_pooled"), known(size).alias("_size")).withColumn("_gap", F.col("_score") - F.col("_pooled"))


def _eligible(c: DataFrame, least: int) -> DataFrame:
    return c.filter((F.col("_size") >= least) & F.col("_score").isNotNull())


def _quantiles(rows: DataFrame, value: str, names: dict[str, float]) -> DataFrame:
    q = Q.exact_quantiles(rows, ["_g"], value, sorted(set(names.values())))
    return q.groupBy("_g").agg(*[F.max(F.when(F.col("quantile") == at, F.col("value"))).alias(name) for name, at in names.items()])


def _ranks(rows: DataFrame, value: str) -> DataFrame:
    """rows with `value` replaced by its average rank, shifted by a constant of its pool: correlations do not see that."""
    numbered = X.global_row_number(rows.select("_g", value), [F.asc("_g"), F.asc(value)], "_i")
    mean = numbered.groupBy("_g", value).agg(F.avg("_i").alias("_rank"))
    return rows.join(mean, ["_g", value], "left").withColumn(value, F.col("_rank")).drop("_rank")


def selection_report(rows: DataFrame, by: list[str], item: str, score: str, pooled: str, size: str, least: int = 30) -> DataFrame:
    """One row a pool (`by`): candidates whose size is at least `least` and whose score is known take part.

    n_rows, n_eligible; mean, median, deviation and maximum of scores; mean and median of pooled scores; median and ninth decile of
    gaps (score less pooled score); selected, the item of the highest score (ties: the smallest item), and selected_by_pooled;
    same_selection; premiums of the selected over mean and median; its gap and the share of gaps no larger; rank correlations of size
    with score, with its distance from the median and, if all are known, with the absolute gap; what choosing by pooled scores
    changes in score, pooled score and size.  Pools of fewer than two candidates have counts only; unknown values are NULL.
    """
    c = _candidates(rows, by, item, score, pooled, size)
    counts = c.groupBy("_g").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when((F.col("_size") >= least) & F.col("_score").isNotNull(), 1)).alias("n_eligible"))
    el = written(_eligible(c, least), "candidates")
    best = lambda key: F.min(F.when(F.col(key).isNotNull(), F.struct((-F.col(key)).alias("k"), F.col("_item").alias("item"), F.col("_score").alias("score"), F.col("_pooled").alias("pooled"), F.col("_size").alias("size"))))
    stats = el.groupBy("_g").agg(
        F.avg("_score").alias("score_mean"), F.stddev_samp("_score").alias("score_sd"), F.max("_score").alias("score_max"), F.avg("_pooled").alias("pooled_mean"), F.count("_gap").alias("_gaps"),
        best("_score").alias("a"), best("_pooled").alias("b"),
    )
    parts = [_quantiles(el, "_score", {"score_median": 0.5}), _quantiles(el, "_pooled", {"pooled_median": 0.5}), _quantiles(el, "_gap", {"gap_median": 0.5, "gap_p90": 0.9})]
    s = written(reduce(lambda left, right: left.join(right, "_g", "left"), [counts, stats, *parts]), "pools")
    per = el.join(s.select("_g", F.col("a.score").alias("_best"), F.col("a.pooled").alias("_bestp"), "score_median"), "_g")
    per = per.withColumn("_dev", F.abs(F.col("_score") - F.col("score_median"))).withColumn("_abs", F.abs("_gap")).withColumn("_under", (F.col("_gap") <= F.col("_best") - F.col("_bestp")).cast("double"))
    ranked = per.select("_g", "_size", "_score", "_dev", "_abs", "_under")
    for value in ("_size", "_score", "_dev", "_abs"):
        ranked = _ranks(ranked, value)
    rho = ranked.groupBy("_g").agg(*[X.correlation("_size", c).alias(name) for c, name in (("_score", "rho_n_vs_score"), ("_dev", "rho_n_vs_absdev"), ("_abs", "rho_n_vs_absgap"))], F.avg("_under").alias("selected_gap_pctile"))
    s = s.join(rho, "_g", "left")
    enough = F.col("n_eligible") >= 2
    gap = F.col("a.score") - F.col("a.pooled")
    out: dict[str, Column] = {c: F.col(c) for c in ("score_mean", "score_median", "score_sd", "score_max", "pooled_mean", "pooled_median", "gap_median", "gap_p90")}
    out |= {"selected": F.col("a.item"), "selected_by_pooled": F.col("b.item"), "same_selection": F.col("a.item") == F.col("b.item"), "premium_vs_random": F.col("a.score") - F.col("score_mean"), "premium_vs_median": F.col("a.score") - F.col("score_median")}
    out |= {"selected_gap": gap, "selected_gap_pctile": F.when(gap.isNotNull(), F.col("selected_gap_pctile"))} | {c: F.col(c) for c in ("rho_n_vs_score", "rho_n_vs_absdev")}
    out |= {"rho_n_vs_absgap": F.when(F.col("_gaps") == F.col("n_eligible"), F.col("rho_n_vs_absgap"))} | {f"delta_{c}": F.col(f"b.{c}") - F.col(f"a.{c}") for c in ("score", "pooled", "size")}
    return s.select("_g.*", "n_rows", "n_eligible", *[F.when(enough, v).alias(c) for c, v in out.items()])


def size_quartiles(rows: DataFrame, by: list[str], item: str, score: str, pooled: str, size: str, least: int = 30) -> DataFrame:
    """(by, quartile, n_lo, n_hi, k, score_mean, score_sd, score_max, absgap_median) of the candidates by quartile of size, right ends
    closed; pools of fewer than two candidates and quartiles without any have no row."""
    el = written(_eligible(_candidates(rows, by, item, score, pooled, size), least), "candidates")
    cuts = _quantiles(el, "_size", {f"_q{i}": i / 4 for i in (1, 2, 3)}).join(el.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")), "_g").filter("_n > 1")
    placed = el.join(cuts, "_g").withColumn("quartile", sum((F.col("_size") > F.col(f"_q{i}")).cast("int") for i in (1, 2, 3)) + 1).withColumn("_abs", F.abs("_gap"))
    placed = placed.select(F.struct("_g", "quartile").alias("_g"), "_size", "_score", "_abs")
    stats = placed.groupBy("_g").agg(F.min("_size").alias("n_lo"), F.max("_size").alias("n_hi"), F.count(F.lit(1)).alias("k"), F.avg("_score").alias("score_mean"), F.stddev_samp("_score").alias("score_sd"), F.max("_score").alias("score_max"))
    out = stats.join(_quantiles(placed, "_abs", {"absgap_median": 0.5}), "_g", "left")
    return out.select("_g._g.*", F.col("_g.quartile").alias("quartile"), "n_lo", "n_hi", "k", "score_mean", "score_sd", "score_max", "absgap_median")
