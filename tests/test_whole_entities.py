"""Cases that the entity queries once left out."""

from __future__ import annotations

from lodestrata.queries import reference


def test_entities_of_every_type_are_scored(spark, tmp_path):
    kinds = ["person", "institution", "product", "index", "event", "policy", "macro_theme"]
    nodes = [(f"Brand{k}", k, [f"Other{k}"]) for k in kinds]
    spark.createDataFrame(nodes, "name string, node_type string, aliases array<string>").write.parquet(str(tmp_path / "world_nodes.parquet"))
    spark.createDataFrame([], "primary_drivers array<struct<driver string, strength double>>").write.parquet(str(tmp_path / "node_states.parquet"))
    records = [(k, "news", f"About Other{k} today") for k in kinds]
    spark.createDataFrame(records, "id string, title string, body string").write.parquet(str(tmp_path / "raw_information.parquet"))
    assert {(r.id, r.kind) for r in reference.entity_score(spark, str(tmp_path)).collect()} == {(k, k) for k in kinds}
