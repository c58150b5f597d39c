"""Named queries over the driver's tables, with their DuckDB SQL."""

from . import classify, context, generation, harness, layers, logit_losses, logs, more, prep, scores, selection

_MODULES = [prep, selection, scores, logit_losses, more, context, generation, harness, logs, classify, layers]
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
