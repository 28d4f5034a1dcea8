"""Queries of the llm problems and their SQL."""

from __future__ import annotations

from lodestrata.llm.bpe import encode_documents
from lodestrata.llm.groups import match_groups
from lodestrata.llm.name_variants import entity_members, variant_pairs
from lodestrata.llm.near_duplicates import similar_groups, similar_pairs
from lodestrata.llm.packing import pack_documents
from lodestrata.llm.sentences import split_sentences
from lodestrata.sources.tables import table


def p1_found(spark, folder):
    return match_groups(table(spark, folder, "node_matches"))


def p2_found(spark, folder):
    return variant_pairs(table(spark, folder, "world_nodes"))


def p2_groups(spark, folder):
    """Entity, and first exact copy, of every record that has a variant."""
    return entity_members(table(spark, folder, "world_nodes"))


def p7_found(spark, folder):
    return similar_pairs(table(spark, folder, "raw_information"), table(spark, folder, "dedup_checks"))


def p7_groups(spark, folder):
    """Class, group and number of links of every record."""
    return similar_groups(table(spark, folder, "raw_information"), table(spark, folder, "dedup_checks"))


def p8_ids(spark, folder):
    return encode_documents(table(spark, folder, "documents"))


def p9_packed(spark, folder):
    return pack_documents(table(spark, folder, "documents"), table(spark, folder, "context_windows"))


def p10_found(spark, folder):
    return split_sentences(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_groups, p7_found, p7_groups, p8_ids, p9_packed, p10_found)}

ORACLE = {
    "p1_found": r"""
WITH RECURSIVE ids AS (
  SELECT lower(regexp_replace(left_node_id, '[\s{}]+', '', 'g')) AS a, lower(regexp_replace(right_node_id, '[\s{}]+', '', 'g')) AS b, *
  FROM node_matches),
judged AS (
  SELECT least(a, b) AS src, greatest(a, b) AS dst, decision,
         row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY judged_at DESC NULLS LAST, match_id DESC) AS rn
  FROM ids WHERE a <> '' AND b <> ''),
links AS (SELECT src, dst FROM judged WHERE rn = 1 AND decision = 'merge'),
arcs AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
reach AS (SELECT src AS node, src AS other FROM arcs
          UNION SELECT reach.node, arcs.dst FROM reach JOIN arcs ON arcs.src = reach.other)
SELECT node AS node_id, min(other) AS group_id FROM reach GROUP BY node""",
    # all pairs of one type whose sizes allow the threshold, by lists of hashed stretches
    "p7_found": r"""
WITH least AS (SELECT info_type, min(threshold) AS least FROM dedup_checks WHERE info_type IS NOT NULL AND threshold IS NOT NULL GROUP BY 1),
t AS (SELECT id, info_type, trim(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM raw_information WHERE id IS NOT NULL),
s AS (SELECT id, info_type, least, list_distinct(list_transform(generate_series(1, length(t) - 4), lambda i: hash(substr(t, i, 5)))) AS s FROM t JOIN least USING (info_type) WHERE length(t) >= 5),
p AS (SELECT least(a.id, b.id) AS l, greatest(a.id, b.id) AS r, a.least, len(a.s) + len(b.s) AS n, len(list_intersect(a.s, b.s)) AS k
      FROM s a JOIN s b ON a.info_type = b.info_type AND a.id < b.id AND least(len(a.s), len(b.s)) >= a.least * greatest(len(a.s), len(b.s)))
SELECT DISTINCT l AS left_info_id, r AS right_info_id FROM p WHERE k / (n - k) >= least""",
}
