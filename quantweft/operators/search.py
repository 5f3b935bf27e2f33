"""Parameter search: sweeps as Spark tasks, an evolution strategy on the driver with batches in Spark, racing with paired errors."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(**axes: list) -> list[dict]:
    """All combinations, first axis slowest."""
    return [dict(zip(axes, values, strict=True)) for values in itertools.product(*axes.values())]


def fingerprint(config: dict) -> str:
    """Sixteen hexadecimal digits of a configuration, whatever the order of its keys."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def run_sweep(spark: SparkSession, objective: Callable[[dict], dict], configs: list[dict], config_schema: str, result_schema: str) -> DataFrame:
    """A row a configuration in the order given: index, config, result, error.  A configuration that fails does not stop the others."""
    names = [c.split()[0] for c in result_schema.split(", ")]

    def evaluate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for config in frame.drop(columns="index").to_dict("records"):
                try:
                    result = objective(config)
                    rows.append({n: result.get(n) for n in names} | {"error": None})
                except Exception as e:  # noqa: BLE001  the row says what went wrong
                    rows.append(dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"})
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(rows, columns=[*names, "error"])], axis=1)

    table = spark.createDataFrame([(i, *c.values()) for i, c in enumerate(configs)], f"index int, {config_schema}")
    parts = min(len(configs), spark.sparkContext.defaultParallelism)
    return table.repartition(parts, "index").mapInPandas(evaluate, f"index int, {config_schema}, {result_schema}, error string").orderBy("index")


def best(results: DataFrame, metric: str, largest: bool = True) -> dict:
    """The configuration with the best known value; of equal ones the first."""
    row = results.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric) if largest else F.asc(metric), "index").limit(1).collect()
    if not row:
        raise ValueError(f"no value of {metric}")
    return row[0].asDict()


def evolve(evaluate: Callable[[np.ndarray], np.ndarray], dim: int, budget: int, seed: int, sigma: float = 0.3) -> tuple[np.ndarray, float, int]:
    """CMA evolution strategy on [0, 1]^dim with restarts of doubled and of small populations; (best x, value, evaluations).

    evaluate takes a population (rows) and gives its values (larger is better); it may spread the rows over Spark tasks.
    """
    rng = np.random.default_rng(seed)
    top_x, top_v, used, large, spent = np.full(dim, 0.5), -math.inf, 0, 0, [0, 0]
    while used < budget:
        small = large > 0 and spent[1] < spent[0]
        size = 4 + int(3 * math.log(dim + 1))
        size = int(size * (0.5 * 2**large) ** (rng.random() ** 2)) if small else size * 2**large
        size = max(4, size)
        began = used
        mean = rng.random(dim) if used else np.full(dim, 0.5)
        s, cov, pc, ps = sigma * (10 ** (-2 * rng.random()) if small else 1.0), np.eye(dim), np.zeros(dim), np.zeros(dim)
        mu = size // 2
        w = np.log(mu + 0.5) - np.log(np.arange(1, mu + 1))
        w /= w.sum()
        eff = 1 / (w**2).sum()
        cs, damp = (eff + 2) / (dim + eff + 5), 1 + (eff + 2) / (dim + eff + 5)
        cc, c1 = 4 / (dim + 4), 2 / ((dim + 1.3) ** 2 + eff)
        cm = min(1 - c1, 2 * (eff - 2 + 1 / eff) / ((dim + 2) ** 2 + eff))
        stale, last = 0, -math.inf
        while used < budget and stale < 20 and s > 1e-9:
            vals, vecs = np.linalg.eigh(cov)
            root = vecs * np.sqrt(np.maximum(vals, 1e-20))
            z = rng.standard_normal((size, dim))
            x = np.clip(mean + s * z @ root.T, 0, 1)
            v = np.asarray(evaluate(x), dtype=float)
            used += size
            order = np.argsort(-v, kind="stable")
            if v[order[0]] > top_v:
                top_x, top_v = x[order[0]].copy(), float(v[order[0]])
            stale = stale + 1 if v[order[0]] <= last + 1e-12 else 0
            last = max(last, float(v[order[0]]))
            y = (x[order[:mu]] - mean) / s
            step = w @ y
            mean = mean + s * step
            ps = (1 - cs) * ps + math.sqrt(cs * (2 - cs) * eff) * (vecs @ ((vecs.T @ step) / np.sqrt(np.maximum(vals, 1e-20))))
            pc = (1 - cc) * pc + math.sqrt(cc * (2 - cc) * eff) * step
            cov = (1 - c1 - cm) * cov + c1 * np.outer(pc, pc) + cm * (y.T * w) @ y
            s *= math.exp(min(1, cs / damp * (np.linalg.norm(ps) / (math.sqrt(dim) * (1 - 1 / (4 * dim))) - 1)))
        spent[small] += used - began
        large += not small
    return top_x, top_v, used


def race(candidates: list, offsets: list[int], run: Callable[[list[tuple]], list[float]], k: float = 3.0, least: int = 5) -> list[int]:
    """Indices of the candidates left after rounds over seed offsets: one goes when the paired mean deficit to the leader exceeds
    k standard errors, from `least` rounds on."""
    alive, scores = list(range(len(candidates))), {i: [] for i in range(len(candidates))}
    for n, offset in enumerate(offsets, 1):
        for i, v in zip(alive, run([(candidates[i], offset) for i in alive]), strict=True):
            scores[i].append(v)
        if n < least or len(alive) == 1:
            continue
        lead = max(alive, key=lambda i: float(np.mean(scores[i])))
        keep = []
        for i in alive:
            d = np.array(scores[lead]) - np.array(scores[i])
            if i == lead or d.mean() <= k * d.std(ddof=1) / math.sqrt(n):
                keep.append(i)
        alive = keep
    return alive


def noise_rule(rows: DataFrame, value: str, a: str, b: str, by: str, k: float = 2.0) -> DataFrame:
    """(mean_a, sd_a, n_a, mean_b, sd_b, n_b, winner): of two candidates the one whose mean is larger by more than k times the larger
    deviation, else NULL."""
    stat = lambda x: rows.filter(F.col(by) == x).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    both = stat(a).toDF("mean_a", "sd_a", "n_a").crossJoin(stat(b).toDF("mean_b", "sd_b", "n_b"))  # a row each
    d = F.col("mean_a") - F.col("mean_b")
    known = F.col("sd_a").isNotNull() & F.col("sd_b").isNotNull()
    return both.withColumn("winner", F.when(known & (F.abs(d) > k * F.greatest("sd_a", "sd_b")), F.when(d > 0, F.lit(a)).otherwise(F.lit(b))))


def noise_rules(rows: DataFrame, value: str, pairs: DataFrame, by: str, k: float = 2.0) -> DataFrame:
    """noise_rule for all pairs (a, b) of candidates that have rows, from one aggregation."""
    stat = rows.groupBy(by).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    side = lambda x: stat.toDF(x, f"mean_{x}", f"sd_{x}", f"n_{x}")
    d = F.col("mean_a") - F.col("mean_b")
    known = F.col("sd_a").isNotNull() & F.col("sd_b").isNotNull()
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("winner", F.when(known & (F.abs(d) > k * F.greatest("sd_a", "sd_b")), F.when(d > 0, F.col("a")).otherwise(F.col("b"))))


def paired_difference(rows: DataFrame, value: str, a: str, b: str, by: str, key: str) -> DataFrame:
    """(mean, se, n) of a less b over the keys (seeds) that both have."""
    side = lambda x, c: rows.filter(F.col(by) == x).select(key, F.col(value).alias(c))
    d = side(a, "a").join(side(b, "b"), key).select((F.col("a") - F.col("b")).alias("d"))
    return d.agg(F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("se"), F.count("d").alias("n"))
