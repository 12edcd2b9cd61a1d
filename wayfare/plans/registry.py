"""Every query over the driver's tables, with the SQL it must agree with."""

from __future__ import annotations

from wayfare.plans.queries import Query, connectors, events, merges, rules, spanish, streams, texts

GROUPS = (events, merges, texts, spanish, streams, connectors, rules)

QUERIES: dict[str, Query] = {name: query for module in GROUPS for name, query in module.group.queries.items()}
ORACLES: dict[str, str] = {name: sql for module in GROUPS for name, sql in module.group.oracles.items()}
