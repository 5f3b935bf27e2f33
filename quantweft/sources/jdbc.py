"""Tables of a relational database, read in parallel by ranges of a column; filters and columns are pushed down by Spark."""

from __future__ import annotations

import os
from collections.abc import Mapping
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

#: Rows a round trip.
FETCH = 10_000


def resolve(dsn: str | None, env: Mapping[str, str] | None = None, variable: str = "DATABASE_URL") -> dict[str, str]:
    """url, user and password of a dsn such as postgresql://user:password@host:5432/name; without one, of the environment variable."""
    dsn = dsn or (os.environ if env is None else env).get(variable)
    if not dsn:
        raise ValueError(f"no database: give a dsn or set {variable}")
    at = urlsplit(dsn)
    if not at.hostname or not at.path.strip("/"):
        raise ValueError("a dsn has a host and a database name")
    scheme = {"postgres": "postgresql"}.get(at.scheme, at.scheme)
    out = {"url": f"jdbc:{scheme}://{at.hostname}{f':{at.port}' if at.port else ''}/{at.path.strip('/')}"}
    return out | {k: unquote(v) for k, v in (("user", at.username), ("password", at.password)) if v}


def options(dsn: str | None, table: str, column: str | None = None, lower: str | None = None, upper: str | None = None, parts: int = 1, env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options of Spark's JDBC source.  With a column (number, date or timestamp) `parts` tasks read a range of it each."""
    out = resolve(dsn, env) | {"dbtable": table, "fetchsize": str(FETCH)}
    if column:
        if lower is None or upper is None:
            raise ValueError("reading by ranges needs both ends")
        out |= {"partitionColumn": column, "lowerBound": lower, "upperBound": upper, "numPartitions": str(parts)}
    return out


def read(spark: SparkSession, dsn: str | None, table: str, **ranges: object) -> DataFrame:
    """A table or a query in brackets with a name."""
    return spark.read.format("jdbc").options(**options(dsn, table, **ranges)).load()
