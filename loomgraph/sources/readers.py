"""Readers: Markdown with frontmatter, article XML, question sets, Python trees, edge shards and file tails."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import CODE_EDGE, CODE_NODE, OBJECT

#: Folders and files that hold no objects.
EXCLUDED_TOP = (".git", ".venv", ".pytest_cache", ".ruff_cache", "schemas", "specs", "plans", "research", "prompts", "external-specs", "review-outputs", "input-artifacts", ".agents", "tools", "tests", "scripts", "examples")
EXCLUDED_ANY = ("raw", "staging", "artifacts", "derived", "discovery", ".cache", "docs")
SKIPPED_ROOT_FILES = ("README.md", "CONTRIBUTING.md", "LICENSE.md", "CHANGELOG.md", "SECURITY.md", "AGENTS.md", "CLAUDE.md")
IGNORED_CODE = (".git", ".venv", "__pycache__", ".pytest_cache", "build", "dist")


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path (relative to root), content, size of all files below root whose name matches."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    where = F.regexp_replace(F.col("path"), r"^\w+:/*", "/")
    return found.select(F.regexp_replace(where, F.lit("^/*" + root.split(":")[-1].strip("/").replace(".", r"\.") + "/"), F.lit("")).alias("path"), "content", F.col("length").alias("size"))


def markdown(spark: SparkSession, root: str, scope: str | None = None, exclude: tuple[str, ...] | None = None) -> DataFrame:
    """Objects of a Markdown tree; a file that can't be read becomes a row with load_error.

    scope keeps files with a part of that name in their path; exclude, where given, stands for all excluded folders and
    names top folders only. Links out of the tree are not looked at: object stores have none.
    """
    rows = files(spark, root, "*.md")
    parts = F.split("path", "/")
    top = F.get(parts, 0)
    nested = F.size(parts) > 1
    tops, anywhere = (EXCLUDED_TOP, EXCLUDED_ANY) if exclude is None else (exclude, ())
    keep = ~top.isin(*tops) & ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, anywhere)).cast("array<string>")) & ~(~nested & top.isin(*SKIPPED_ROOT_FILES))
    if scope is not None:
        keep = keep & F.array_contains(parts, scope)
    return parse_objects(rows.where(keep).select("path", F.col("content").cast("string").alias("text")))


def python_sources(spark: SparkSession, root: str) -> DataFrame:
    """path, text of the Python files of a tree, without what builds and tools leave there."""
    own = ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED_CODE)))
    return files(spark, root, "*.py").where(own).select("path", F.col("content").cast("string").alias("text"))


def appended(now: DataFrame, cursors: DataFrame) -> DataFrame:
    """path, content (what is new), byte_offset, file_sha256 of now(path, content) against cursors(path, byte_offset,
    file_sha256); the last two are the next cursors.

    A file goes on from its cursor if its bytes up to there still hash alike. A file that was cut, replaced or is new
    is read from the start; one without new bytes gives an empty content.
    """
    past = cursors.select("path", F.col("byte_offset").alias("_from"), F.col("file_sha256").alias("_hash"))
    size = F.length("content")
    grown = (F.col("_from") <= size) & (F.sha2(F.expr("substring(content, 1, int(_from))"), 256) == F.col("_hash"))
    return now.select("path", "content").join(past, "path", "left").select(
        "path", F.when(grown, F.expr("substring(content, int(_from) + 1)")).otherwise(F.col("content")).alias("content"),
        size.cast("long").alias("byte_offset"), F.sha2("content", 256).alias("file_sha256"))


def parse_objects(texts: DataFrame) -> DataFrame:
    """OBJECT rows of texts(path, text): YAML between fences, then the body. YAML has no built-in reader."""
    schema = T._parse_datatype_string(OBJECT)
    lists = {f.name for f in schema if isinstance(f.dataType, T.ArrayType) and f.name not in ("relations", "unknown_fields")}

    def text(value):
        return None if value is None else str(value)

    def one(path: str, content: str) -> dict:
        import yaml

        row = dict.fromkeys(schema.names) | {"path": path, "raw_body": content or ""}
        pieces = (content or "").split("---", 2)
        if not (content or "").startswith("---") or len(pieces) < 3:
            return row | {"load_error": "no frontmatter"}
        row["raw_body"] = pieces[2].strip()
        try:
            found = yaml.safe_load(pieces[1])
        except yaml.YAMLError as error:
            return row | {"load_error": f"bad YAML: {type(error).__name__}"}
        if not isinstance(found, dict):
            return row | {"load_error": "frontmatter is no mapping"}
        own = set(schema.names) - {"path", "raw_body", "load_error", "unknown_fields"}
        for name in own & found.keys():
            value = found[name]
            if name in lists:
                row[name] = None if value is None else [text(x) for x in (value if isinstance(value, list) else [value])]
            elif name == "relations":
                row[name] = [{"type": text(r.get("type")), "target": text(r.get("target")), "soft_link": bool(r.get("soft_link")), "created_date": text(r.get("created_date"))} for r in value or [] if isinstance(r, dict)]
            elif name == "validity":
                row[name] = {k: text(value.get(k)) for k in ("valid_from", "valid_until")} if isinstance(value, dict) else None
            else:
                row[name] = text(value)
        row["unknown_fields"] = sorted(str(k) for k in found.keys() - own)
        return row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(p, t) for p, t in zip(batch["path"], batch["text"])], columns=schema.names)

    return texts.select("path", "text").mapInPandas(run, schema)


def entity_files(spark: SparkSession, path: str) -> DataFrame:
    """file, reason of XML files (plain or compressed) that declare entities; one such line anywhere is enough."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.where(F.lower("value").contains("<!entity")).select("file", F.lit("entity_declaration_forbidden").alias("reason")).distinct()


def articles(spark: SparkSession, path: str) -> DataFrame:
    """pmid, title, abstract, sections, year, journal, mesh, citations, corrections of article XML.

    Rows without a whole-number id go, and so do all rows of files that declare entities (see entity_files). A section
    named twice keeps its first place and its last text; parts without text count for nothing.
    """
    ids = "ArticleIdList struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>"
    schema = (
        "MedlineCitation struct<PMID: struct<_VALUE: string>, Article: struct<ArticleTitle: string, Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string>>>, "
        "Abstract: struct<AbstractText: array<struct<_VALUE: string, _Label: string, _NlmCategory: string>>>, ArticleDate: array<struct<Year: string>>>, "
        "CommentsCorrectionsList: struct<CommentsCorrections: array<struct<_RefType: string, PMID: struct<_VALUE: string>>>>, "
        "MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: struct<_VALUE: string, _UI: string, _MajorTopicYN: string>>>>>, "
        f"PubmedData struct<ReferenceList: array<struct<Reference: array<struct<{ids}>>>>>"
    )
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path).withColumn("file", F.col("_metadata.file_path"))
    rows = rows.join(entity_files(spark, path), "file", "left_anti")
    c = "MedlineCitation"

    def some(text: Column) -> Column:
        return F.nullif(F.trim(text), F.lit(""))

    def listed(name: str) -> Column:
        return F.coalesce(F.col(name), F.array())

    label = lambda s: F.upper(F.coalesce(F.nullif(s["_Label"], F.lit("")), F.nullif(s["_NlmCategory"], F.lit(""))))
    parts = F.filter(F.transform(listed(f"{c}.Article.Abstract.AbstractText"), lambda s: F.struct(label(s).alias("name"), some(s["_VALUE"]).alias("text"))), lambda s: s["text"].isNotNull())
    named = F.filter("parts", lambda s: s["name"].isNotNull())
    sections = F.transform(F.array_distinct(F.transform(named, lambda s: s["name"])), lambda n: F.element_at(F.filter("parts", lambda s: s["name"] == n), -1))
    mesh = F.filter(F.transform(listed(f"{c}.MeshHeadingList.MeshHeading"), lambda m: F.struct(F.coalesce(m["DescriptorName"]["_UI"], F.lit("")).alias("ui"), some(m["DescriptorName"]["_VALUE"]).alias("name"), F.coalesce(m["DescriptorName"]["_MajorTopicYN"] == "Y", F.lit(False)).alias("major"))), lambda m: m["name"].isNotNull())
    cited = F.flatten(F.transform(listed("PubmedData.ReferenceList"), lambda r: F.flatten(F.transform(F.coalesce(r["Reference"], F.array()), lambda x: F.filter(F.coalesce(x["ArticleIdList"]["ArticleId"], F.array()), lambda i: i["_IdType"] == "pubmed")))))
    corrected = F.transform(listed(f"{c}.CommentsCorrectionsList.CommentsCorrections"), lambda x: F.struct(F.coalesce(x["_RefType"], F.lit("CommentOn")).alias("ref_type"), some(x["PMID"]["_VALUE"]).alias("pmid")))
    year = F.coalesce(F.col(f"{c}.Article.Journal.JournalIssue.PubDate.Year"), F.get(F.col(f"{c}.Article.ArticleDate"), 0)["Year"])
    return rows.withColumn("parts", parts).select(
        F.trim(f"{c}.PMID._VALUE").try_cast("long").alias("pmid"), F.coalesce(some(F.col(f"{c}.Article.ArticleTitle")), F.lit("Untitled Article")).alias("title"),
        F.array_join(F.transform("parts", lambda s: s["text"]), " ").alias("abstract"), sections.alias("sections"),
        F.trim(year).try_cast("int").alias("year"), F.trim(f"{c}.Article.Journal.Title").alias("journal"),
        mesh.alias("mesh"), F.filter(F.transform(cited, lambda i: F.trim(i["_VALUE"]).try_cast("long")), lambda x: x.isNotNull()).alias("citations"),
        F.filter(corrected, lambda x: x["pmid"].isNotNull()).alias("corrections"),
    ).where("pmid is not null")


#: What every object made from an article says.
ARTICLE_FIELDS = {
    "schema_version": "3.8.10", "taxonomy_path": "03. Natural Science", "taxonomy_id": "TX-PERS-03", "object_type": "Article", "domain": "natural_science",
    "source_type": "document", "author": "process:nlm", "audience": "engineer", "status": "established", "consensus": "accepted", "evidence": "observed",
    "verification": "peer_verified", "authority": "informative", "confidence": "0.9",
}
ARTICLE_ID = "PERS-ART-MED_%08d-0001"


def article_objects(rows: DataFrame, today: str, scope: str = "personal") -> DataFrame:
    """OBJECT rows of articles: soft relations CITES and SUPERSEDES, the first four major headings as aliases, the
    first ten headings and the journal as keywords, the abstract by sections as body; due again a year on, in January."""

    def links(kind: str, targets: Column) -> Column:
        return F.transform(targets, lambda x: F.struct(F.lit(kind).alias("type"), F.format_string(ARTICLE_ID, x).alias("target"), F.lit(True).alias("soft_link"), F.lit(None).cast("string").alias("created_date")))

    def titled(text: Column) -> Column:
        return F.array_join(F.transform(F.split(F.lower(text), r"(?<=\P{L})(?=\p{L})"), F.initcap), "")

    amended = F.filter(F.transform("corrections", lambda x: x["pmid"].try_cast("long")), lambda x: x.isNotNull())
    major = F.transform(F.filter("mesh", lambda m: m["major"]), lambda m: m["name"])
    named = F.transform(F.slice("mesh", 1, 10), lambda m: F.lower(m["name"]))
    by_section = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("### "), titled(s["name"]), F.lit("\n\n"), s["text"], F.lit("\n"))), "\n")
    body = F.when(F.size("sections") > 0, F.concat(F.lit("## Abstract\n\n"), by_section)).when(F.col("abstract") != "", F.concat(F.lit("## Abstract\n\n"), "abstract")).otherwise("*No abstract available.*")
    day = F.to_date(F.lit(today))
    number = F.col("pmid").cast("string")
    made = {name: F.lit(value) for name, value in ARTICLE_FIELDS.items()} | {
        "id": F.format_string(ARTICLE_ID, "pmid"), "path": F.concat(F.format_string(ARTICLE_ID, "pmid"), F.lit(".md")), "title": F.col("title"), "scope": F.lit(scope),
        "aliases": F.concat(F.array(F.concat(F.lit("PMID:"), number), number), F.slice(major, 1, 4)),
        "keywords": F.concat(named, F.when(F.coalesce(F.length("journal"), F.lit(0)) > 0, F.array(F.lower("journal"))).otherwise(F.array().cast("array<string>"))),
        "language": F.array(F.lit("en")), "source_refs": F.array(F.concat(F.lit("pmid:"), number)),
        "last_modified": day.cast("string"), "next_review": F.make_date(F.year(day) + 1, F.lit(1), F.lit(1)).cast("string"),
        "relations": F.concat(links("CITES", F.col("citations")), links("SUPERSEDES", amended)),
        "unknown_fields": F.array().cast("array<string>"), "raw_body": F.rtrim(F.concat(F.lit("# "), "title", F.lit("\n\n"), F.regexp_replace(body, r"\s+$", ""))),
    }
    return rows.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(OBJECT)])


def article_edges(rows: DataFrame) -> DataFrame:
    """u, v: citations one way, subject headings both ways."""
    u = F.format_string(ARTICLE_ID, "pmid")
    cites = F.transform("citations", lambda x: F.struct(u.alias("u"), F.format_string(ARTICLE_ID, x).alias("v")))
    there = F.transform("mesh", lambda m: F.struct(u.alias("u"), F.concat(F.lit("MESH_"), m["ui"]).alias("v")))
    back = F.transform("mesh", lambda m: F.struct(F.concat(F.lit("MESH_"), m["ui"]).alias("u"), u.alias("v")))
    return rows.select(F.explode(F.concat(cites, there, back)).alias("e")).select("e.u", "e.v")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """pubid, question, labels, contexts of a Parquet or JSON question set."""
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path)
        return rows.select("pubid", "question", F.col("context.labels").alias("labels"), F.col("context.contexts").alias("contexts"))
    kind = "map<string, struct<QUESTION: string, LABELS: array<string>, CONTEXTS: array<string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("id", "q"))
    return whole.select(F.col("id").try_cast("long").alias("pubid"), F.col("q.QUESTION").alias("question"), F.col("q.LABELS").alias("labels"), F.col("q.CONTEXTS").alias("contexts")).where("pubid is not null and question is not null")


def question_articles(rows: DataFrame) -> DataFrame:
    """Rows as of articles(), for article_objects, of questions: labels name the contexts' sections, the first label is
    a heading beside a fixed one; a label without a context, or the reverse, counts for nothing."""
    labels, contexts = F.coalesce("labels", F.array().cast("array<string>")), F.coalesce("contexts", F.array().cast("array<string>"))
    n = F.least(F.size(labels), F.size(contexts))
    pairs = F.arrays_zip(F.slice(labels, 1, n).alias("name"), F.slice(contexts, 1, n).alias("text"))
    first = F.coalesce(F.get(labels, 0), F.lit("Study"))
    heading = lambda ui, name, major: F.struct(F.lit(ui).alias("ui"), name.alias("name"), F.lit(major).alias("major"))
    return rows.withColumn("pairs", pairs).select(
        F.col("pubid").cast("long").alias("pmid"), F.regexp_replace("question", r"\?+$", "").alias("title"),
        F.array_join(F.transform("pairs", lambda x: F.concat(x["name"], F.lit(": "), x["text"])), "\n\n").alias("abstract"),
        F.transform(F.array_distinct(F.transform("pairs", lambda x: x["name"])), lambda k: F.element_at(F.filter("pairs", lambda x: x["name"] == k), -1)).alias("sections"),
        F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("journal"),
        F.array(heading("D000001", F.lit("Biomedicine"), True), heading("D000002", first, False)).alias("mesh"),
        F.array().cast("array<long>").alias("citations"), F.array().cast("array<struct<ref_type:string,pmid:string>>").alias("corrections"))


def code_graph(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of Python sources(path, text): definitions, bases, calls by name, imports and tests."""

    def extract(path: str, text: str) -> tuple[list, list]:
        nodes, edges = [(path, "FILE", path.rsplit("/", 1)[-1], path, 0)], []
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError):
            return nodes, edges
        module = path.removesuffix(".py").replace("/", ".")
        nodes.append((module, "MODULE", module, path, 1))
        edges.append((path, module, "DEFINES", path))

        def visit(body, owner, inside):
            for item in body:
                if isinstance(item, ast.ClassDef):
                    name = f"{owner}.{item.name}"
                    nodes.append((name, "CLASS", item.name, path, item.lineno))
                    edges.append((owner, name, "DEFINES", path))
                    edges.extend((name, b.id, "INHERITS", path) for b in item.bases if isinstance(b, ast.Name))
                    visit(item.body, name, True)
                elif isinstance(item, ast.FunctionDef | ast.AsyncFunctionDef):
                    name = f"{owner}.{item.name}"
                    test = "test" in path.lower() or item.name.startswith("test")
                    nodes.append((name, "TEST" if test else "METHOD" if inside else "FUNCTION", item.name, path, item.lineno))
                    edges.append((owner, name, "DEFINES", path))
                    called = sorted({n.func.id for n in ast.walk(item) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)})
                    edges.extend((name, c, "CALLS", path) for c in called)
                    if test:
                        edges.extend((name, c, "TESTS_SYMBOL", path) for c in called)
                elif isinstance(item, ast.Assign):
                    for target in item.targets:
                        if isinstance(target, ast.Name):
                            nodes.append((f"{owner}.{target.id}", "SYMBOL", target.id, path, item.lineno))
                            edges.append((owner, f"{owner}.{target.id}", "DEFINES", path))

        visit(tree.body, module, False)
        for item in ast.walk(tree):
            if isinstance(item, ast.Import):
                edges.extend((module, a.name, "IMPORTS", path) for a in item.names)
            elif isinstance(item, ast.ImportFrom) and item.module:
                edges.append((module, item.module, "IMPORTS", path))
        return nodes, edges

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [extract(p, t) for p, t in zip(batch["path"], batch["text"])]
            fields = ("node_id", "kind", "name", "path", "line")
            yield pd.DataFrame({"nodes": [[dict(zip(fields, n)) for n in a] for a, _ in found], "edges": [[dict(zip(("src", "dst", "type", "path"), e)) for e in b] for _, b in found]})

    kind = f"nodes array<struct<{CODE_NODE.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{CODE_EDGE.replace(' ', ':').replace(',:', ',')}>>"
    both = sources.select("path", "text").mapInPandas(run, kind)
    nodes = both.select(F.inline("nodes")).dropDuplicates(["node_id", "kind"])
    edges = both.select(F.inline("edges")).distinct()
    # A name that one node alone has stands for that node.
    only = nodes.groupBy("name").agg(F.min("node_id").alias("only"), F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("name").alias("dst"), "only")
    edges = edges.join(only, "dst", "left").select("src", F.coalesce("only", "dst").alias("dst"), "type", "path")
    return nodes, edges


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, change (added, changed, deleted) between two lists of (path, hash)."""
    both = before.select("path", F.col("hash").alias("old")).join(now.select("path", F.col("hash").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def edge_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("u string, v string").parquet(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
