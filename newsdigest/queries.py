"""Registry of every implemented query: key -> (Spark callable, SQL twin or None)."""

from __future__ import annotations

from . import queries_basic, queries_dates, queries_digest, queries_plans, queries_sources, queries_stream


def _registry():
    reg = {}
    for mod in (queries_digest, queries_basic, queries_dates, queries_sources, queries_stream, queries_plans):
        reg.update(mod.QUERIES)
    return reg


def flagship(spark, sf_dir):
    from newsdigest.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return queries_digest.q_digest(spark, sf_dir)


def spark_queries():
    return {k: v[0] for k, v in _registry().items()}


def sql_queries():
    out = {}
    for k, (_, sql) in _registry().items():
        if sql is not None:
            out[k] = sql() if callable(sql) else sql
    return out
