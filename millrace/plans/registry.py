"""All queries of the library but those of the llm subpackage."""

from __future__ import annotations

from millrace.plans import (  # noqa: F401
    adapters, cleaning, codecs, dedup, evidence, extras, ledger, mixture, packing, pages, relational, series, shards, sources, stores, streams, vocabulary, firewall,
)
from millrace.plans.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
