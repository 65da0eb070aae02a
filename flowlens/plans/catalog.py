"""Registry of the named queries and their oracle SQL."""

from __future__ import annotations

import functools

from flowlens.plans import flow_queries, serve_queries, train_queries
from flowlens.session import ship_package


def _modules():
    return [flow_queries, train_queries, serve_queries]


def _utc(fn):
    """Flow times are epoch microseconds rendered in UTC; pin the session zone before the
    plan is analysed (time-zone-aware expressions bind it at analysis time)."""
    @functools.wraps(fn)
    def q(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        return fn(spark, sf_dir)
    return q


def queries() -> dict:
    out = {}
    for m in _modules():
        out.update({k: _utc(v) for k, v in m.queries().items()})
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _modules():
        out.update(m.oracle())
    return out
