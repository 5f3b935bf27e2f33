"""Files that are read and written: day partitions with cache-aside, generations of column sets, append-only JSON ledgers."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Dataset:
    """A table of one trading day a partition: name, schema, sort keys, version (a new version is a new path)."""

    name: str
    schema: T.StructType
    order: tuple[str, ...]
    version: int = 1

    def path(self, root: str, day: date) -> str:
        return f"{root}/{self.name}/v{self.version}/day={day.isoformat()}"

    def compact(self, df: DataFrame) -> DataFrame:
        """df in the declared types.  NULL in a required column, a fraction in a whole one and overflow raise."""
        out = []
        for f in self.schema.fields:
            c = F.col(f.name)
            if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ByteType)) and not isinstance(df.schema[f.name].dataType, T.IntegralType):
                c = F.when(c.isNotNull() & (c != F.floor(c)), F.raise_error(F.lit(f"{f.name} has a fraction"))).otherwise(c)
            c = c.cast(f.dataType)  # ANSI: overflow raises
            out.append((c if f.nullable else F.when(c.isNull(), F.raise_error(F.lit(f"{f.name} is null"))).otherwise(c)).alias(f.name))
        return df.select(*out)


def required(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def load_day(spark: SparkSession, dataset: Dataset, day: date, fetch: Callable[[date], DataFrame], root: str, today: date, codes: list[str] | None = None, columns: list[str] | None = None, refresh: bool = False) -> DataFrame:
    """One day: from the cache if it is closed and there, else fetched and, if closed and not empty, cached.

    Codes and columns are pushed into the Parquet scan.  Unknown columns raise; codes must be a list.
    """
    if isinstance(codes, str):
        raise TypeError("codes must be a list")
    unknown = set(columns or ()) - set(dataset.schema.names)
    if unknown:
        raise KeyError(f"unknown columns: {', '.join(sorted(unknown))}")
    path = dataset.path(root, day)
    closed = day < today
    out = None
    if closed and not refresh and _exists(spark, f"{path}/_SUCCESS"):
        out = spark.read.schema(dataset.schema).parquet(path)
    else:
        out = dataset.compact(fetch(day))
        if closed and not out.isEmpty():
            out.sortWithinPartitions(*dataset.order).write.mode("overwrite").parquet(path)
            out = spark.read.schema(dataset.schema).parquet(path)
    if codes is not None:
        out = out.filter(F.col("code").isin(codes))
    return out.select(*columns) if columns else out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class GenerationStore:
    """Keyed tables as generations: a write goes to a new folder, then one pointer file is replaced; readers of the generation
    before are not disturbed, older ones go."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)

    def _key(self, key: str) -> Path:
        if not re.fullmatch(r"[A-Za-z0-9_.=-]+(/[A-Za-z0-9_.=-]+)*", key) or ".." in key:
            raise ValueError(f"bad key: {key}")
        return self.root / key

    def write(self, key: str, df: DataFrame, meta: dict | None = None) -> int:
        at = self._key(key)
        n = (self.meta(key) or {"generation": 0})["generation"] + 1
        df.write.mode("overwrite").parquet(str(at / f"g{n}"))
        tmp = at / f"meta-{uuid.uuid4().hex}"
        tmp.write_text(json.dumps({"generation": n, "columns": df.columns, **(meta or {})}))
        os.replace(tmp, at / "meta.json")
        for old in at.glob("g*"):
            if int(old.name[1:]) < n - 1:
                for f in sorted(old.rglob("*"), reverse=True):
                    f.unlink() if f.is_file() else f.rmdir()
                old.rmdir()
        return n

    def meta(self, key: str) -> dict | None:
        at = self._key(key) / "meta.json"
        return json.loads(at.read_text()) if at.exists() else None

    def has(self, key: str) -> bool:
        return self.meta(key) is not None

    def read(self, key: str, columns: list[str] | None = None) -> DataFrame:
        meta = self.meta(key)
        if meta is None:
            raise KeyError(key)
        df = self.spark.read.parquet(str(self._key(key) / f"g{meta['generation']}"))
        return df.select(*columns) if columns else df


def append_row(path: str | Path, row: dict, durable: bool = False) -> None:
    """One JSON line at the end of a ledger."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(row, ensure_ascii=False, sort_keys=True, default=str) + "\n")
        f.flush()
        if durable:
            os.fsync(f.fileno())


def read_ledger(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """The rows of a JSON ledger; corrupt lines are left out, or raise if strict."""
    rows = spark.read.text(path).filter("trim(value) <> ''").withColumn("r", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    if strict:
        bad = F.col("r._bad").isNotNull()
        rows = rows.withColumn("r", F.when(bad, F.raise_error(F.concat(F.lit("corrupt line: "), F.col("value")))).otherwise(F.col("r")))
    return rows.filter("r is not null and r._bad is null").select("r.*").drop("_bad")


def merge_runs(rows: DataFrame) -> DataFrame:
    """One row a run of start and end rows (run_id, event, label, status, ts)."""
    of = lambda event, c: F.max(F.when(F.col("event") == event, F.col(c)))
    return rows.groupBy("run_id").agg(of("start", "label").alias("label"), of("start", "ts").alias("started"), of("end", "status").alias("status"), of("end", "ts").alias("ended"))


def record_trials(spark: SparkSession, path: str, rows: list[dict], key: Callable[[dict], str]) -> int:
    """Appends the configurations that the ledger does not have yet; the number of distinct ones after."""
    have = set()
    if Path(path).exists():
        have = {r.fingerprint for r in read_ledger(spark, path, "fingerprint string").collect()}  # one short string a trial
    for row in rows:
        k = key(row)
        if k not in have:
            append_row(path, {"fingerprint": k, "config": row})
            have.add(k)
    return len(have)


def outside(hold_out: tuple[date, date], day: Column) -> Column:
    """Rows before or after a hold-out period (both ends belong to it)."""
    lo, hi = hold_out
    return ~day.between(F.lit(lo), F.lit(hi))


def checked_outside(df: DataFrame, hold_out: tuple[date, date], column: str) -> DataFrame:
    """df, with an error on the first row inside the hold-out period."""
    inside = ~outside(hold_out, F.col(column))
    return df.withColumn(column, F.when(inside, F.raise_error(F.lit("row inside the hold-out period"))).otherwise(F.col(column)))


def latest_severe(filings: DataFrame, severity: Column, code: str, now: datetime, days: int = 7) -> DataFrame:
    """The latest severe filing of a code in the last days: by date, then number."""
    recent = filings.filter((F.col("code") == code) & (F.datediff(F.lit(now.date()), F.col("filed")) <= days))
    return recent.filter(severity == "HARD").orderBy(F.desc("filed"), F.desc("filing_no")).limit(1)
