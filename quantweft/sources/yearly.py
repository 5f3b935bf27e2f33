"""A copy of a table by year, of which only the years that changed are read in full and written again.

Each year has a fingerprint: its number of rows, its first and last date and a sum of row hashes, in whatever order the rows come.  An
anti-join with the fingerprints of the copy gives the years to write; they replace their own partition folders (dynamic overwrite),
others are not touched.  Fingerprints are written after the rows, so a run that breaks off is made good by the next.  Everything is
a Spark read or write: any store that Spark reaches will do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINGERPRINT = "n long, first date, last date, digest decimal(38,0), year int"


class YearlyCopy:
    """At `root`: rows/year=.., fingerprints/year=..; `date` names the date column of the table."""

    def __init__(self, spark: SparkSession, root: str, date: str = "date"):
        self.spark, self.rows, self.marks, self.date = spark, f"{root}/rows", f"{root}/fingerprints", date

    def fingerprints(self, table: DataFrame) -> DataFrame:
        """(n, first, last, digest, year) of each year; rows without a date belong to year 0."""
        year = F.coalesce(F.year(self.date), F.lit(0)).alias("year")
        # two different hashes of a row: sums of one alone could meet by two changes that cancel
        digest = F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)") + F.hash(*table.columns).cast("decimal(38,0)") * F.lit(4_294_967_291).cast("decimal(10,0)"))
        found = table.groupBy(year).agg(F.count(F.lit(1)).alias("n"), F.min(self.date).cast("date").alias("first"), F.max(self.date).cast("date").alias("last"), digest.cast("decimal(38,0)").alias("digest"))
        return found.select("n", "first", "last", "digest", "year")

    def stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(FINGERPRINT).parquet(self.marks)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], FINGERPRINT)

    def refresh(self, table: DataFrame) -> list[int]:
        """Brings the copy up to date and returns the years that were written.  Years that the table no longer has become empty."""
        now, before = self.fingerprints(table), self.stored()
        same = ["year", "n", "first", "last", "digest"]
        key = [now[c].eqNullSafe(before[c]) for c in same]
        # a row a year
        fresh = now.join(before, key, "left_anti").collect()
        gone = [r.year for r in before.filter("n > 0").join(now, "year", "left_anti").select("year").collect()]
        years = [r.year for r in fresh]
        if years:
            part = table.withColumn("year", F.coalesce(F.year(self.date), F.lit(0))).filter(F.col("year").isin(years))
            self._put(part.repartition("year"), self.rows)
        if years or gone:
            marks = self.spark.createDataFrame([*fresh, *[(0, None, None, None, y) for y in gone]], FINGERPRINT)
            self._put(marks.coalesce(1), self.marks)
        return sorted([*years, *gone])

    def _put(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)

    def read(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """The rows of the years from first to last: other folders are not opened."""
        years = [r.year for r in self.stored().filter("n > 0").select("year").collect()]
        years = [y for y in years if (first is None or y >= first) and (last is None or y <= last)]
        return self.spark.read.parquet(self.rows).filter(F.col("year").isin(years)).drop("year")
