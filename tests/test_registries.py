"""Registries from YAML files into their rules, and stores with broken lines."""

import json

import pytest

from loomgraph.operators import validate
from loomgraph.sources import registries

FILES = {
    "object_registry": "object_types:\n  Article: {code: ART, required_facets: [language, mood], tag_strategy: domain}\ndomains:\n  - maths  # a note\n  - logic\n",
    "relation_registry": "relations:\n  CITES: {inverse_view: CITED_BY, dag: false, symmetric: false, source_types: [Article], target_types: [Nothing]}\n",
    "facet_registry": "facets:\n  language: {cardinality: 1..N, allows_none: false, values: [en, none]}\n",
    "taxonomy_registry": "taxonomy:\n  - {taxonomy_id: T1, name: One, scope: personal, parent_id: null}\n  - {taxonomy_id: T2, name: Two, scope: engineering, parent_id: T1}\n",
    "epistemic_registry": "dimensions:\n  evidence:\n    values: {observed: {rank: 3}, derived: {rank: 2}}\n",
    "governance_policy": "status_consensus_rules:\n  draft: {allowed_consensus: [proposed]}\n",
    "source_registry": "source_types:\n  document: {source_taxonomy: [Artifact, Note]}\nsource_taxonomy:\n  Artifact: {children: [Record]}\n",
    "actor_registry": "actor_types:\n  human: {description: d}\n",
    "threshold_policy": "thresholds:\n  - {threshold_id: A, value: 2, owner: here.md}\n  - {threshold_id: A, value: 3, owner: gone.md}\n",
    "spec_ownership": "invariant_families:\n  - {family_id: F, owner: here.md}\n",
}


def test_registries_and_their_rules(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / f"{name}.yaml").write_text("schema_version: '1'\n" + text)
    found = registries.load(spark, str(tmp_path), spark.createDataFrame([("here.md",)], "path string"))
    assert {(r.dimension, k, v.rank) for r in found["epistemic_registry"].collect() for k, v in r["values"].items()} == {("evidence", "observed", 3), ("evidence", "derived", 2)}
    assert [r.name for r in found["domains"].collect()] == ["maths", "logic"] and found["threshold_policy"].count() == 2
    told = {(r.code, r.field) for r in validate.registry_rules(found).collect()}
    assert told == {
        ("E082", "thresholds.A"), ("E083", "thresholds.A.owner"), ("E086", "source_types.document.source_taxonomy"), ("E023", "relations.CITES.target_types"),
        ("E020", "object_types.Article.required_facets"), ("E018", "taxonomy.T2.parent_id"), ("E026", "facets.language")}
    (tmp_path / "facet_registry.yaml").write_text("- a\n")
    (tmp_path / "spec_ownership.yaml").unlink()
    (tmp_path / "threshold_policy.yaml").write_text("other: 1\n")
    with pytest.raises(registries.Unreadable, match="facet_registry.yaml is no mapping; spec_ownership.yaml is missing; threshold_policy.yaml has no thresholds"):
        registries.load(spark, str(tmp_path))


def test_stores_with_broken_lines(spark, tmp_path):
    assert registries.candidates(spark, str(tmp_path / "none")).count() == 0 and registries.bridges(spark, str(tmp_path / "b.json")).count() == 0
    (tmp_path / "c").mkdir()
    lines = [{"candidate_id": "a", "status": "pending"}, {"candidate_id": "b", "trigger_source_ids": ["x"]}, {"candidate_id": "a", "status": "approved"}, {"status": "lost"}]
    (tmp_path / "c" / "candidates.jsonl").write_text("\n".join([*map(json.dumps, lines), "", "{broken"]))
    got = {(r.candidate_id, r.status, r.kind) for r in registries.candidates(spark, str(tmp_path / "c")).collect()}
    assert got == {("a", "approved", "relation"), ("b", None, "node")}
    (tmp_path / "b.json").write_text(json.dumps({"x": {"bridge_id": "x", "status": "pending"}}))
    assert [r.bridge_id for r in registries.bridges(spark, str(tmp_path / "b.json")).collect()] == ["x"]
    (tmp_path / "b.json").write_text("{broken")
    assert registries.bridges(spark, str(tmp_path / "b.json")).count() == 0
