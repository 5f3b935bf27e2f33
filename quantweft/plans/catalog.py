"""Query catalogue of the engine's own operators: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import functions as F

from quantweft.plans import book_queries, market_queries, more_queries, panel_queries, preparation_queries, risk_queries, session_queries, stats_queries, stream_queries

GROUPS = (market_queries, panel_queries, preparation_queries, stats_queries, book_queries, risk_queries, stream_queries, more_queries, session_queries)


def _as_text(query, columns: list[str]):
    """The query with its dates as text, which every client reads alike."""

    def run(spark, sf_dir):
        out = query(spark, sf_dir)
        return out.withColumns({c: F.col(c).cast("string") for c in columns})

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def _entries() -> Iterator[tuple[str, Callable, str | None]]:
    for group in GROUPS:
        for name, (query, sql, *dates) in group.QUERIES.items():
            if dates:
                columns = dates[0].split()
                query = _as_text(query, columns)
                if sql:
                    sql = f"select * replace ({', '.join(f'cast({c} as varchar) as {c}' for c in columns)}) from ({sql}) q"
            yield name, query, sql


def queries() -> dict[str, Callable]:
    return {name: query for name, query, _ in _entries()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _entries() if sql}
