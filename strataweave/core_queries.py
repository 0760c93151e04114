"""All queries over the core operators and their SQL."""

from __future__ import annotations

from strataweave.operators import snapshots
from strataweave.queries import analytics, confidence, evaluation, graph, pipelines, resolve, texts, views  # noqa: F401
from strataweave.queries.registry import ORACLES, QUERIES, Query, expand, query

P6_SQL = """
WITH v AS (SELECT version_id, lead(version_id) OVER (ORDER BY created_at, version_id) AS nxt FROM (SELECT DISTINCT version_id, created_at FROM version_metadata)),
k AS (SELECT version_id, entity_id, arg_max(struct_pack(l := label, t := node_type, d := description, c := confidence, p := list_sort(map_entries(props))), loaded_at) AS s
      FROM kg_snapshots WHERE entity_id IS NOT NULL GROUP BY version_id, entity_id),
p AS (SELECT version_id AS f, nxt AS t FROM v WHERE nxt IS NOT NULL),
a AS (SELECT p.f, p.t, k.entity_id, k.s FROM p JOIN k ON k.version_id = p.f),
b AS (SELECT p.f, p.t, k.entity_id, k.s FROM p JOIN k ON k.version_id = p.t)
SELECT coalesce(a.f, b.f) AS version_from, coalesce(a.t, b.t) AS version_to, coalesce(a.entity_id, b.entity_id) AS entity_id,
  CASE WHEN a.entity_id IS NULL THEN 'added' WHEN b.entity_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b ON a.f = b.f AND a.t = b.t AND a.entity_id = b.entity_id
WHERE a.entity_id IS NULL OR b.entity_id IS NULL OR a.s IS DISTINCT FROM b.s
"""


@query("p6_found", P6_SQL)
def p6_found(t):
    return snapshots.snapshot_changes(t.kg_snapshots, t.version_metadata)


@query("p6_version_diff", f"SELECT version_from, version_to, count(*) FILTER (change_kind = 'added') AS n_added, count(*) FILTER (change_kind = 'removed') AS n_removed, count(*) FILTER (change_kind = 'changed') AS n_changed FROM ({P6_SQL}) q GROUP BY 1, 2")
def p6_version_diff(t):
    return snapshots.version_diff(snapshots.snapshot_changes(t.kg_snapshots, t.version_metadata))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: expand(v) for k, v in ORACLES.items()}
