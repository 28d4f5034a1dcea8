"""Queries of the general problems 3 to 6 and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators.bitemporal import attached_states
from lodestrata.operators.hierarchy import descendant_counts, descendants, parent_links, resolve_roots
from lodestrata.operators.history import build_history, history_rows
from lodestrata.sources.tables import table
from lodestrata.streaming.late import corrections, replayed_revisions


def p3_found(spark, folder):
    roots = resolve_roots(parent_links(table(spark, folder, "world_node_edges")))
    return roots.select(F.col("node").alias("node_id"), F.col("root").alias("root_node_id"), F.col("depth").cast("int").alias("depth"))


def p3_paths(spark, folder):
    """Path and number of descendants of every node."""
    resolved = resolve_roots(parent_links(table(spark, folder, "world_node_edges")), with_path=True)
    return resolved.join(descendant_counts(resolved), "node").select(F.col("node").alias("node_id"), "path", "n_descendants")


def p3_descendants(spark, folder):
    """All descendants of every node, with their distance."""
    resolved = resolve_roots(parent_links(table(spark, folder, "world_node_edges")), with_path=True)
    return descendants(resolved).select(F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance")


def p4_found(spark, folder):
    return attached_states(*(table(spark, folder, n) for n in ("node_attachments", "raw_information", "node_states")))


def p5_found(spark, folder):
    return history_rows(build_history(table(spark, folder, "node_state_updates"), with_content=False))


def p5_history(spark, folder):
    """The history with the content of every version."""
    history = build_history(table(spark, folder, "node_state_updates"))
    return history.select("node_id", "version", "valid_from", "valid_to", F.sha2("core_logic", 256).alias("content_sha"))


def _revisions(spark, folder):
    return replayed_revisions(table(spark, folder, "raw_information"), table(spark, folder, "info_sources"))


def p6_found(spark, folder):
    return corrections(_revisions(spark, folder)[0])


def p6_issues(spark, folder):
    """All issues of all periods with their counts."""
    return _revisions(spark, folder)[0]


def p6_dropped(spark, folder):
    """Counts of the records beyond the cut-off."""
    return _revisions(spark, folder)[1]


QUERIES = {f.__name__: f for f in (p3_found, p3_paths, p3_descendants, p4_found, p5_found, p5_history, p6_found, p6_issues, p6_dropped)}

_LINKS = """
links AS (
  SELECT DISTINCT child_node_id AS c, parent_node_id AS p FROM world_node_edges
  WHERE regexp_replace(lower(trim(relationship_type)), '[ _-]+', '_', 'g') = 'belongs_to'),
ids AS (SELECT c AS node FROM links UNION SELECT p FROM links WHERE p IS NOT NULL),
up AS (SELECT node, min(p) AS parent FROM ids LEFT JOIN links ON node = c GROUP BY node)"""

_WALK = f"""
WITH RECURSIVE {_LINKS},
walk AS (
  SELECT node, node AS root, 0 AS depth, [node] AS path FROM up WHERE parent IS NULL
  UNION ALL SELECT up.node, walk.root, walk.depth + 1, list_append(walk.path, up.node) FROM walk JOIN up ON up.parent = walk.node)
"""

_FIRST = """
WITH src AS (SELECT lower(trim(source)) AS s, min(trim(source)) AS proper FROM info_sources GROUP BY 1),
first AS (
  SELECT coalesce(proper, lower(trim(r.source))) AS source, published_at AS pub, ingested_at AS ing,
         row_number() OVER (PARTITION BY coalesce(proper, lower(trim(r.source))), coalesce(content_hash, 'id:' || id) ORDER BY ingested_at, id) AS rn
  FROM raw_information r LEFT JOIN src ON src.s = lower(trim(r.source)) WHERE ingested_at IS NOT NULL),
seen AS (
  SELECT source, CAST(pub AT TIME ZONE 'UTC' AS DATE) AS day, CAST(ing AT TIME ZONE 'UTC' AS DATE) AS arr, ing AT TIME ZONE 'UTC' AS ing
  FROM first WHERE rn = 1 AND pub IS NOT NULL AND source IS NOT NULL),
classed AS (
  SELECT source, day, arr, CASE WHEN ing <= CAST(day AS TIMESTAMP) + INTERVAL 30 HOUR THEN 0
                                WHEN ing <= CAST(day AS TIMESTAMP) + INTERVAL 96 HOUR THEN 1 ELSE 2 END AS k FROM seen)
"""

_HISTORY = r"""
WITH rows AS (
  SELECT *, trim(regexp_replace(core_logic, '[ \t\r\n]+', ' ', 'g')) AS x,
         row_number() OVER (PARTITION BY node_id, effective_from ORDER BY received_at DESC NULLS LAST, update_id DESC) AS rn
  FROM node_state_updates WHERE node_id IS NOT NULL AND effective_from IS NOT NULL),
ev AS (SELECT node_id, effective_from AS t, core_logic, CASE WHEN op = 'close' THEN NULL ELSE x END AS x FROM rows
       WHERE rn = 1 AND (op = 'close' OR core_logic IS NOT NULL)),
b AS (SELECT *, lag(x) OVER w AS px FROM ev WINDOW w AS (PARTITION BY node_id ORDER BY t)),
borders AS (SELECT * FROM b WHERE x IS DISTINCT FROM px),
v AS (SELECT node_id, t, x, core_logic, lead(t) OVER w AS e,
             CAST(sum(CASE WHEN x IS NULL THEN 0 ELSE 1 END) OVER w AS INT) AS version
      FROM borders WINDOW w AS (PARTITION BY node_id ORDER BY t))
"""

ORACLE = {
    "p3_found": f"""{_WALK}
SELECT node AS node_id, root AS root_node_id, CAST(depth AS INT) AS depth FROM walk
UNION ALL SELECT node, 'cycle', CAST(-1 AS INT) FROM up WHERE node NOT IN (SELECT node FROM walk)""",
    "p3_paths": f"""{_WALK},
counts AS (SELECT a.node, count(*) AS n FROM walk a JOIN walk b ON b.root = a.root AND b.depth > a.depth AND list_contains(b.path, a.node) GROUP BY 1)
SELECT up.node AS node_id, path, coalesce(n, 0) AS n_descendants
FROM up LEFT JOIN walk ON walk.node = up.node LEFT JOIN counts ON counts.node = up.node""",
    "p3_descendants": f"""{_WALK}
SELECT path[i] AS node_id, node AS descendant_id, CAST(depth + 1 - i AS INT) AS distance FROM (SELECT node, depth, path, unnest(generate_series(1, depth)) AS i FROM walk)""",
    "p4_found": """
WITH st AS (SELECT DISTINCT node_id, version, effective_from AS f, effective_to AS e, created_at AS c FROM node_states),
pts AS (SELECT DISTINCT a.attachment_id AS info_id, a.node_id, r.published_at AS t
        FROM node_attachments a JOIN raw_information r ON r.id = a.attachment_id
        WHERE a.attachment_type = 'raw_info' AND r.published_at IS NOT NULL),
best AS (SELECT info_id, p.node_id, t, version, e,
                row_number() OVER (PARTITION BY info_id, p.node_id ORDER BY f DESC, c DESC, version DESC) AS rn
         FROM pts p JOIN st ON st.node_id = p.node_id AND f <= t AND c <= t)
SELECT info_id, node_id, version FROM best b
WHERE rn = 1 AND (e IS NULL OR e > t OR EXISTS (SELECT 1 FROM st WHERE st.node_id = b.node_id AND st.f = b.e AND st.c > b.t))""",
    "p5_found": f"""{_HISTORY}
SELECT node_id, version, strftime(t AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS valid_from,
       coalesce(strftime(e AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), 'open') AS valid_to FROM v WHERE x IS NOT NULL""",
    "p5_history": f"""{_HISTORY}
SELECT node_id, version, t AS valid_from, e AS valid_to, sha256(core_logic) AS content_sha FROM v WHERE x IS NOT NULL""",
    "p6_found": f"""{_FIRST}
SELECT DISTINCT source, strftime(day, '%Y-%m-%d') AS period_day, strftime(arr, '%Y-%m-%d') AS arrival_day FROM classed WHERE k = 1""",
    "p6_issues": f"""{_FIRST},
n AS (SELECT source, day AS period_day, CASE WHEN k = 1 THEN arr END AS arrival_day, count(*) AS added FROM classed WHERE k < 2 GROUP BY ALL)
SELECT source, period_day, arrival_day, added,
       CAST(sum(added) OVER (PARTITION BY source, period_day ORDER BY arrival_day NULLS FIRST) AS BIGINT) AS records FROM n""",
    "p6_dropped": f"""{_FIRST}
SELECT source, day AS period_day, arr AS arrival_day, count(*) AS dropped FROM classed WHERE k = 2 GROUP BY ALL""",
}
