"""Registries from a folder of YAML files, and stores of candidates and bridges, as tables.

A registry is a section of a file: a mapping, whose keys become a column, or a list. One table of shapes says which; the
files are small and read by Spark like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.exchange import yaml_json

#: Registry: (file, section, column for the keys of a mapping or None for a list, columns; one
#: column alone is a list of texts).
SHAPES = {
    "object_registry": ("object_registry", "object_types", "name", "code string, category string, allowed_scopes array<string>, required_facets array<string>, tag_strategy string"),
    "domains": ("object_registry", "domains", None, "name string"),
    "relation_registry": ("relation_registry", "relations", "name", "category string, inverse_view string, dag boolean, symmetric boolean, source_types array<string>, target_types array<string>"),
    "facet_registry": ("facet_registry", "facets", "name", "cardinality string, allows_none boolean, values array<string>"),
    "taxonomy_registry": ("taxonomy_registry", "taxonomy", None, "taxonomy_id string, name string, scope string, parent_id string"),
    "epistemic_registry": ("epistemic_registry", "dimensions", "dimension", "values map<string,struct<rank:int>>"),
    "governance_policy": ("governance_policy", "status_consensus_rules", "status", "allowed_consensus array<string>"),
    "source_registry": ("source_registry", "source_types", "name", "source_taxonomy array<string>"),
    "source_taxonomy": ("source_registry", "source_taxonomy", "root", "children array<string>"),
    "actor_registry": ("actor_registry", "actor_types", "name", "description string"),
    "threshold_policy": ("threshold_policy", "thresholds", None, "threshold_id string, decision_domain string, value string, unit string, owner string"),
    "spec_ownership": ("spec_ownership", "invariant_families", None, "family_id string, owner string"),
}
CANDIDATE = "candidate_id string, candidate_type string, confidence double, status string, created_at string, expires_at string, scope string, source_id string, target_id string, trigger_source_ids array<string>"
BRIDGE = "bridge_id string, knowledge_object_id string, structural_node_id string, bridge_type string, status string"


class Unreadable(ValueError):
    """A registry file isn't there, is no mapping or lacks a section."""


def load(spark: SparkSession, folder: str, paths: DataFrame | None = None) -> dict[str, DataFrame]:
    """The registries below folder, as `validate.registry_rules` takes them; paths(path), where given, is handed on.

    A file that isn't there, is no YAML mapping or lacks its section raises, with all that is wrong.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(folder)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.yaml$", "")
    files = found.select(name.alias("file"), yaml_json(F.col("content").cast("string")).alias("json")).where(F.col("file").isin(*{s[0] for s in SHAPES.values()}))
    sections = files.select("file", F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>")).alias("keys"), F.col("json").isNotNull().alias("ok"))
    there = {r["file"]: (r["ok"], set(r["keys"])) for r in sections.collect()}  # a row a registry file
    wrong = sorted({f"{f}.yaml " + ("is missing" if f not in there else "is no mapping" if not there[f][0] else f"has no {s}") for f, s, _, _ in SHAPES.values() if f not in there or s not in there[f][1]})
    if wrong:
        raise Unreadable("; ".join(wrong))
    out = {}
    for registry, (file, section, key, columns) in SHAPES.items():
        one = files.where(F.col("file") == file).select(F.get_json_object("json", f"$.{section}").alias("j"))
        fields = [c.split(" ")[0] for c in columns.split(", ")]
        if key:
            rows = one.select(F.explode(F.from_json("j", _map(columns))).alias(key, "v"))
            out[registry] = rows.select(key, *[f"v.{f}" for f in fields])
        elif len(fields) == 1:
            out[registry] = one.select(F.explode(F.from_json("j", "array<string>")).alias(fields[0]))
        else:
            out[registry] = one.select(F.explode(F.from_json("j", f"array<{_struct(columns)}>")).alias("v")).select("v.*")
    if paths is not None:
        out["paths"] = paths
    return out


def _struct(columns: str) -> str:
    return "struct<" + ",".join(":".join(c.strip().split(" ", 1)) for c in columns.split(", ")) + ">"


def _map(columns: str) -> str:
    return f"map<string,{_struct(columns)}>"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """CANDIDATE columns and kind (node or relation) of a store of JSON lines, the last line of each id.

    Lines that are no JSON or have no id are left out; a store that isn't there is empty.
    """
    from .connectors import listed

    if not listed(path, "*"):
        return spark.createDataFrame([], f"{CANDIDATE}, kind string")
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    rows = lines.select(F.from_json("value", CANDIDATE).alias("c"), "at").where("c.candidate_id is not null")
    last = rows.groupBy("c.candidate_id").agg(F.max_by("c", "at").alias("c")).select("c.*")
    node = (F.col("candidate_type") == "node_proposal") | F.col("trigger_source_ids").isNotNull()
    return last.withColumn("kind", F.when(F.coalesce(node, F.lit(False)), "node").otherwise("relation"))


def bridges(spark: SparkSession, path: str) -> DataFrame:
    """BRIDGE rows of a file that maps ids to bridges; empty if the file isn't there or isn't as it should be."""
    from .connectors import listed

    folder, _, name = path.rpartition("/")
    if not any(n == name for n, _, _ in listed(folder, name)):
        return spark.createDataFrame([], BRIDGE)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.map_values(F.from_json("value", _map(BRIDGE)))).alias("b")).where("b.bridge_id is not null").select("b.*")
