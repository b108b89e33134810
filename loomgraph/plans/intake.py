"""Queries over what comes in: envelopes of trajectories and staged tables, with their SQL.

Events are written as logs to the shared folder and read back through the connectors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import rebuild, triage
from ..operators.store import StagedTable
from ..session import shared_folder, table
from ..sources import connectors
from .catalogue import TOKENS_SQL, query


@query("""SELECT event_id, 'Experience' AS category, ts AS event_time, 'sha256:' || sha256(line) AS representation_hash, octet_length(encode(line)) AS byte_size, CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS injections
    FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN TIMESTAMP '2030-01-01' ELSE date_trunc('second', ts) END AS ts, '{"event_id":' || event_id || ',"metadata":{"occurred_at":"' || (CASE WHEN event_id % 9 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END) || '"},"note":"' || (CASE WHEN event_id % 50 = 0 THEN 'rm -rf /' ELSE event_type END) || '"}' AS line FROM events)""")
def trajectory_envelopes(spark, sf):
    """Every event as a line of a log; every ninth doesn't say when it happened."""
    folder = f"{shared_folder(spark)}/loomgraph/logs-{uuid.uuid4().hex}"
    when = F.when(F.col("event_id") % 9 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    note = F.when(F.col("event_id") % 50 == 0, "rm -rf /").otherwise(F.col("event_type"))
    line = F.to_json(F.struct("event_id", F.struct(when.alias("occurred_at")).alias("metadata"), note.alias("note")))
    table(spark, sf, "events").select(line.alias("value")).write.text(folder)
    connectors.register(spark)
    read = spark.read.format("loomgraph_trajectories").option("pattern", "part-*").option("collected_at", "2030-01-01T00:00:00Z").load(folder)
    rows = connectors.envelopes(read, "agent_trajectory")
    number = F.get_json_object(F.regexp_extract("fenced_content", r"\{.*\}", 0), "$.event_id").cast("long")
    return rows.select(number.alias("event_id"), "category", "event_time", "representation.representation_hash", F.col("representation.byte_size").alias("byte_size"), F.size("injections").alias("injections"))


@query("""SELECT doc_id AS proposal_id, lang AS status, sha256(text) AS digest FROM documents""")
def staged_proposals(spark, sf):
    """Documents staged in two commits, the second with half of the first again, then in one folder."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("proposal_id"), F.col("lang").alias("status"), F.sha2("text", 256).alias("digest"))
    staged = StagedTable(spark, f"{shared_folder(spark)}/loomgraph/staged-{uuid.uuid4().hex}", "proposal_id long, status string, digest string", "proposal_id", "digest", ("status",))
    half = rows.where(F.crc32(F.col("proposal_id").cast("string").cast("binary")) % 2 == 0)
    first = staged.commit(half, expected=0)
    staged.commit(rows, expected=first.revision)
    staged.compact()
    return staged.read()


@query("SELECT lang AS status, count(*) AS n FROM documents GROUP BY 1")
def staged_counts(spark, sf):
    """Counts by status as the manifest has them."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("proposal_id"), F.col("lang").alias("status"), F.sha2("text", 256).alias("digest"))
    staged = StagedTable(spark, f"{shared_folder(spark)}/loomgraph/staged-{uuid.uuid4().hex}", "proposal_id long, status string, digest string", "proposal_id", "digest", ("status",))
    staged.commit(rows)
    return spark.createDataFrame(list(staged.manifest()["counts"]["status"].items()), "status string, n long")


#: Documents as legacy notes: some without head, some with a head that says too little, some that are no text.
NOTES_SQL = r"""n AS (SELECT doc_id, doc_id % 8 AS k, 'notes/' || CASE WHEN doc_id % 11 = 0 THEN doc_id || '/README' ELSE 'n_' || doc_id END || CASE WHEN doc_id % 13 = 0 THEN '.txt' ELSE '.md' END AS path, replace(text, '---', '-') AS body FROM documents),
    p AS (SELECT *, substr(sha256(path), 1, 4) AS hex FROM n),
    q AS (SELECT *, CASE WHEN doc_id % 13 = 0 OR doc_id % 11 = 0 THEN 'excluded' WHEN k = 0 THEN 'missing_frontmatter' WHEN k IN (1, 2) THEN 'malformed_metadata' WHEN k = 3 THEN 'ambiguous_scope' WHEN k = 7 THEN 'unicode_decode_error' END AS reason,
            list_sum(list_transform(range(4), lambda i: (instr('0123456789abcdef', substr(hex, i + 1, 1)) - 1) * (16 ** (3 - i))))::BIGINT % 9000 + 1000 AS number FROM p)"""


def _notes(spark, sf):
    """Files, and the rows that migration makes of them."""
    from ..operators import migration

    d = F.col("doc_id")
    path = F.concat(F.lit("notes/"), F.when(d % 11 == 0, F.concat(d, F.lit("/README"))).otherwise(F.concat(F.lit("n_"), d)), F.when(d % 13 == 0, ".txt").otherwise(".md"))
    heads = ["", "---\n- a\n---\n", "---\na: [\n---\n", "---\ntitle: T\n---\n", "---\nscope: engineering\ncategory: misc\ntitle: Note %s\ntags: [Python, Misc]\n---\n", "---\nscope: personal\ntaxonomy_id: TX-ENG-01\nid: PERS-ART-OLD-0007\ntype: memo\n---\n", "---\nscope: personal\ntype: journal\nconfidence: 7\n---\n", ""]
    top = F.element_at(F.array(*[F.format_string(h, d) if "%s" in h else F.lit(h) for h in heads]), (d % 8 + 1).cast("int"))
    body = F.regexp_replace("text", "---", "-")
    text = F.concat(top, body, F.concat(F.lit(" [[n_"), d + 1, F.lit("]] [[Lost|x]]"))).cast("binary")
    files = table(spark, sf, "documents").select(path.alias("path"), F.when(d % 8 == 7, F.concat(F.unhex(F.lit("FF")), text)).otherwise(text).alias("content"))
    types = spark.createDataFrame([("Article", "ART", "domain"), ("Journal", "JRN", "year")], "name string, code string, tag_strategy string")
    taxonomy = spark.createDataFrame([("TX-ENG-01", "root", "engineering"), ("TX-ENG-02", "misc", "engineering"), ("TX-PERS-01", "own", "personal")], "taxonomy_id string, name string, scope string")
    mapping = migration.Mapping(taxonomy={"misc": "TX-ENG-02"}, types={"journal": "Journal"})
    return migration.parsed(files, mapping, types, taxonomy, ("software_engineering", "formal_science"), "2024-03-01T00:00:00Z")


@query(f"""WITH {NOTES_SQL} SELECT path, reason, CASE WHEN reason IS NOT NULL THEN NULL WHEN k = 4 THEN printf('ENG-ART-%s-%04d', substr('NOTE_' || doc_id, 1, 12), number) WHEN k = 5 THEN 'PERS-ART-OLD-0007' ELSE printf('PERS-JRN-2024-%04d', number) END AS id,
    CASE WHEN reason IS NOT NULL THEN NULL WHEN k = 4 THEN 'TX-ENG-02' ELSE 'TX-PERS-01' END AS taxonomy_id, CASE WHEN reason IS NOT NULL THEN NULL WHEN k = 6 THEN 'Journal' ELSE 'Article' END AS object_type, CASE WHEN reason IS NULL THEN 0.5 END AS confidence FROM q""")
def migrated_notes(spark, sf):
    return _notes(spark, sf).select("path", "reason", "id", "taxonomy_id", "object_type", "confidence")


@query(f"WITH {NOTES_SQL} SELECT count(*) AS total_source_files, count(*) FILTER (reason IS NULL) AS eligible_files, count(*) FILTER (reason = 'excluded') AS excluded_files, count(*) FILTER (reason <> 'excluded') AS quarantined_files FROM q")
def migration_counts(spark, sf):
    from ..operators import migration

    return migration.counts(_notes(spark, sf))


@query(f"""WITH {NOTES_SQL}, o AS (SELECT doc_id, path, CASE WHEN k = 4 THEN printf('ENG-ART-%s-%04d', substr('NOTE_' || doc_id, 1, 12), number) WHEN k = 5 THEN 'PERS-ART-OLD-0007' ELSE printf('PERS-JRN-2024-%04d', number) END AS id FROM q WHERE reason IS NULL)
    SELECT a.path AS source_file, 'n_' || (a.doc_id + 1) AS raw_link, b.id AS target FROM o a LEFT JOIN o b ON b.doc_id = a.doc_id + 1 UNION ALL SELECT path, 'Lost', NULL FROM o""")
def migration_links(spark, sf):
    """Wiki links of migrated notes and the objects that they name by file."""
    from ..operators import migration

    return migration.link_proposals(migration.objects(_notes(spark, sf)))


@query(f"SELECT doc_id, len({TOKENS_SQL.format('text')})::INTEGER AS tokens FROM documents")
def rebuilt_lengths(spark, sf):
    """Lengths of documents as an artefact: built over an older state of the corpus, then brought up to date."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), "doc_id", "text", F.sha2("text", 256).alias("digest"))
    older = docs.where("doc_id % 97 <> 5").withColumn("digest", F.when(F.col("doc_id") % 89 == 7, "older").otherwise(F.col("digest")))
    older = older.withColumn("text", F.when(F.col("digest") == "older", "an older text").otherwise(F.col("text")))
    folder = f"{shared_folder(spark)}/loomgraph/artefact-{uuid.uuid4().hex}"
    build = lambda rows: rows.select("bucket", "doc_id", F.size(X.tokenize(F.col("text"))).alias("tokens"))
    rebuild.rebuild(older, build, folder)
    rebuild.rebuild(docs, build, folder)
    return rebuild.load(spark, folder)


def _units(spark, sf):
    """Documents as staged units that mention parts; every seventh file has no reference, every eleventh is a list."""
    d = F.col("doc_id")
    body = F.concat(F.lit('fenced_content: "see [[p'), d % 40, F.lit("|x]] and [[none]] and [[p"), d % 40, F.lit("]]"), F.when(d % 20 == 0, " rm -rf / eval").otherwise(""), F.lit('"\n'))
    text = F.when(d % 11 == 0, "- a\n").when(d % 7 == 0, body).otherwise(F.concat(F.lit("evidence_unit_ref: EU-"), d, F.lit("\nsource_refs: [SRC-"), d, F.lit("]\n"), body))
    return triage.report(triage.units(table(spark, sf, "documents").select(F.concat(F.lit("evidence_units/u"), d, F.lit(".yaml")).alias("path"), text.cast("binary").alias("content"))))


UNITS_SQL = """u AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'error: invalid YAML structure' WHEN doc_id % 7 = 0 THEN 'error: missing evidence_unit_ref' ELSE 'staged' END AS status FROM documents),
    r AS (SELECT doc_id, CASE WHEN status = 'staged' THEN 'EU-' ELSE 'u' END || doc_id AS evidence_unit_ref, status, CASE WHEN status = 'staged' THEN 'p' || (doc_id % 40) END AS mention, CASE WHEN status = 'staged' AND doc_id % 20 = 0 THEN 1 ELSE 0 END AS injections FROM u)"""


@query(f"WITH {UNITS_SQL} SELECT evidence_unit_ref, status, CASE WHEN mention IS NULL THEN '' ELSE 'none,' || mention END AS mentions, CASE WHEN doc_id % 77 <> 0 AND doc_id % 11 <> 0 AND doc_id % 7 <> 0 THEN 'SRC-' || doc_id ELSE '' END AS source_refs, injections FROM r")
def triage_report(spark, sf):
    return _units(spark, sf).select("evidence_unit_ref", "status", F.array_join("candidate_relations", ",").alias("mentions"), F.array_join("source_refs", ",").alias("source_refs"), F.size("injections_detected").alias("injections"))


@query(f"WITH {UNITS_SQL} SELECT evidence_unit_ref, mention, CASE WHEN (doc_id % 40) % 3 = 0 THEN 'PART-' || (doc_id % 40) END AS target FROM r WHERE mention IS NOT NULL UNION ALL SELECT evidence_unit_ref, 'none', NULL FROM r WHERE mention IS NOT NULL")
def triage_drafts(spark, sf):
    """Mentions joined to parts, a third of which are known by an alias."""
    k = F.col("p_partkey")
    parts = table(spark, sf, "part").where(k % 3 == 0).select(F.concat(F.lit("PART-"), k).alias("id"), F.array(F.concat(F.lit("P"), k)).alias("aliases"))
    return triage.drafts(_units(spark, sf), parts)


@query(f"WITH {UNITS_SQL} SELECT count(*) AS total_count, sum(injections)::BIGINT AS injections_count FROM r")
def triage_summary(spark, sf):
    return triage.summary(_units(spark, sf))
