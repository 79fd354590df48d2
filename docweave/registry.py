"""Every query by key, with the SQL that it can be compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.functions import detection, records, text
from docweave.operators import asof, crawl, fulltext, retrieval, search, similarity, vector_index
from docweave.plans import endpoints, lifecycle, pages, sketches  # noqa: F401  endpoints' statements join the others
from docweave.plans.analytics import STATEMENTS
from docweave.sources import corpus, files, html, render, specs, stored
from docweave.streaming import ingest, state, windows
from docweave.tables import plain, run_sql

FLAGSHIP = "hybrid_rrf_search"
Query = Callable[[SparkSession, str], DataFrame]


def _run(sql: str) -> Query:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, sql)


#: modules with queries of their own, beside the shared statements
MODULES = (pages, asof, crawl, retrieval, search, similarity, vector_index, fulltext, corpus, windows, state, ingest, lifecycle, sketches, text, records, specs, render, files, html, stored, detection)


def queries() -> dict[str, Query]:
    out = {k: _run(s.sql) for k, s in STATEMENTS.items()}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {k: s.oracle or plain(s.sql) for k, s in STATEMENTS.items()}
    for module in MODULES:
        out |= module.ORACLES
    return out
