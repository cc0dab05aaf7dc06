"""Registry of named queries: Spark callable + independent SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    ops: str  # inventory ids covered, e.g. "V-05, W-01"
    run: Callable[[SparkSession, str], DataFrame]
    oracle: object | None  # SQLText or str

    def oracle_text(self) -> str | None:
        if self.oracle is None:
            return None
        return self.oracle if isinstance(self.oracle, str) else self.oracle.render()


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: str, oracle: object | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, ops, fn, oracle)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every module that registers queries."""
    from cauce.plans import q_campaign, q_metrics, q_quality, q_decision, q_text, q_models, q_stream, q_lifecycle, q_capture  # noqa: F401
    return REGISTRY
