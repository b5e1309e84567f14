"""All registered queries of the engine's own operators, and the SQL each is checked against.

Query and SQL stand side by side in the modules of this package; a query without SQL has none because SQL
cannot say it (trees of markup, sequence alignment).
"""

from __future__ import annotations

from palimpsest.plans import contents, history, identifiers, lookups, operations, ranking, snapshots

QUERIES: dict = {}
SQL: dict = {}
for _module in (history, identifiers, contents, ranking, operations, lookups, snapshots):
    QUERIES |= {name: query for name, (query, _) in _module.REGISTERED.items()}
    SQL |= {name: sql for name, (_, sql) in _module.REGISTERED.items() if sql}
