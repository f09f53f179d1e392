"""Routing config: an ordered rule list and a handful of stores, read on the driver."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loomlog.operators.routing import UNCLASSIFIED, resolve_scope, route_to_store


@dataclass(frozen=True)
class RoutingConfig:
    default_scope: str = "unset"
    rules: tuple[tuple[str, str], ...] = ()
    stores: dict[str, str] = field(default_factory=dict)
    unclassified: str = UNCLASSIFIED
    auto_sync: bool = True
    log_tool_calls: str = "none"

    def route(self, sessions: DataFrame) -> DataFrame:
        """Adds scope, title and store."""
        return route_to_store(resolve_scope(sessions, self.rules, self.default_scope), self.stores, self.unclassified)

    def rules_df(self, spark: SparkSession) -> DataFrame:
        rows = [(n, needle, scope) for n, (needle, scope) in enumerate(self.rules)]
        return spark.createDataFrame(rows, "ord int, needle string, scope string")

    def stores_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.stores.items()), "scope string, store string")


def load_routing_config(path: str) -> RoutingConfig:
    """Config at `path`; a missing or broken file gives the safe defaults."""
    try:
        with open(path, "rb") as f:
            data = tomllib.load(f)
        rules = tuple((r.get("match", ""), r.get("scope", "unset")) for r in data.get("rule") or [])
        stores = {k: v for k, v in (data.get("brains") or {}).items() if v}
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError, AttributeError):
        return RoutingConfig()
    return RoutingConfig(
        default_scope=data.get("default_scope", "unset"), rules=rules, stores=stores,
        unclassified=data.get("unclassified_path") or UNCLASSIFIED,
        auto_sync=bool(data.get("auto_sync", True)), log_tool_calls=data.get("log_tool_calls", "none"))
