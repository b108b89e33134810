"""Small rules on values: times, ids, sections, links, diagrams and signatures."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, functions as F

from . import text as X

#: Object types suggested by source type; others are concepts.
SUGGESTED_TYPES = {"document": "concept", "code_repository": "specification", "agent_trajectory": "event", "meeting": "event", "thought": "note", "note": "note"}
#: What a diagram may begin with.
DIAGRAMS = (
    "graph flowchart sequenceDiagram classDiagram stateDiagram stateDiagram-v2 erDiagram gantt pie journey mindmap timeline "
    "quadrantChart xychart C4Context C4Container C4Component C4Dynamic C4Deployment gitGraph requirementDiagram sankey block"
).split()
#: Patterns of wiki links at intake, in migration and of diagrams.
INTAKE_LINK = r"\[\[([a-zA-Z0-9_\-\./]+)(?:\|[^\]]+)?\]\]"
MIGRATION_LINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
#: Fixed value: how the note begins that stands over a broken diagram.
FAILURE = "<!-- LINT_FAILURE: mermaid syntax error: "
DIAGRAM = r"(?s)```mermaid[^\S\r\n]*\r?\n(.*?)```"


def tolerant_time(value: Column) -> Column:
    """A timestamp in the session's zone (UTC) from an ISO text; null where it isn't one."""
    return value.cast("string").try_cast("timestamp")


def expiry(created: Column, days: Column) -> Column:
    """created plus days, 90 of them at most."""
    return created + F.make_interval(days=F.least(days, F.lit(90)))


def event_time(occurred: Column, collected: Column, now: Column) -> Column:
    """When it happened, else when it was collected, else now; what isn't a time doesn't count."""
    return F.coalesce(tolerant_time(occurred), tolerant_time(collected), now)


def migration_number(path: Column) -> Column:
    """Four digits that follow from a path."""
    return (F.conv(F.substring(F.sha2(path.cast("binary"), 256), 1, 4), 16, 10).cast("int") % 9000 + 1000).cast("int")


def migration_id(scope: Column, code: Column, title: Column, path: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit("untitled"))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    tag = F.regexp_replace(F.upper(F.substring(slug, 1, 12)), "-", "_")
    prefix = F.when(scope == "personal", "PERS").otherwise("ENG")
    return F.concat_ws("-", prefix, code, F.when(tag == "", "NOTE").otherwise(tag), migration_number(path).cast("string"))


def component_id(number: Column) -> Column:
    return F.format_string("comp_%03d", number)


def community_id(scope: Column, number: Column) -> Column:
    return F.format_string("comm_%s_%03d", scope, number)


def suggested_type(source_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SUGGESTED_TYPES.items() for x in pair])
    return F.coalesce(table[source_type], F.lit("concept"))


def lines_of(body: Column) -> Column:
    return F.split(F.regexp_replace(body, r"\r?\n$", ""), r"\r?\n")


def line_range(spec: Column) -> Column:
    """struct(start, end) of 'N' or 'N-M'; null otherwise."""
    parts = F.regexp_extract_all(F.trim(spec), F.lit(r"^\s*(\d+)\s*(?:-\s*(\d+))?\s*$"), F.lit(0))
    first = F.regexp_extract(F.trim(spec), r"^(\d+)", 1).try_cast("int")
    last = F.regexp_extract(F.trim(spec), r"-\s*(\d+)$", 1).try_cast("int")
    return F.when(F.size(parts) == 1, F.struct(first.alias("start"), F.coalesce(last, first).alias("end")))


def line_slice(body: Column, start: Column, end: Column) -> Column:
    """Lines start..end, counted from 1, both included; null for a range that isn't one or begins beyond the end."""
    lines = lines_of(body)
    fine = (start >= 1) & (end >= start) & (start <= F.size(lines))
    return F.when(fine, F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(F.least(end, F.size(lines)) - start + 1, F.lit(0))), "\n"))


def section(body: Column, heading: Column) -> Column:
    """Text of the first second-level section of that name."""
    found = F.get(F.filter(X.section_map(body), lambda s: s["title"] == heading), 0)
    return F.when(found.isNotNull(), F.trim(F.array_join(F.slice(lines_of(body), found["start_line"] + 1, found["end_line"] - found["start_line"]), "\n")))


def sections(body: Column, found: Column) -> Column:
    """Titles and texts of all second-level sections; of repeated titles the last counts. found: a column that holds
    the body's section_map, which can't be worked out inside a lambda."""
    last = F.filter(found, lambda s, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda o: o["title"] == s["title"]))
    part = lambda s: F.trim(F.array_join(F.slice(lines_of(body), s["start_line"] + 1, s["end_line"] - s["start_line"]), "\n"))
    return F.map_from_entries(F.transform(last, lambda s: F.struct(s["title"], part(s))))


def intake_links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(INTAKE_LINK), F.lit(1))


def migration_links(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(MIGRATION_LINK), F.lit(1)), lambda x: F.trim(x))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def diagram_fault(inner: Column) -> Column:
    """Why a diagram can't be drawn; null if nothing speaks against it."""
    body = F.trim(F.regexp_replace(inner, r"^\s+|\s+$", ""))
    first = F.trim(F.get(F.split(body, r"\r?\n"), 0))
    plain = F.regexp_replace(body, "\"[^\"]*\"|'[^']*'", '""')
    known = F.lit(False)
    for name in DIAGRAMS:
        known = known | first.startswith(name)
    fault = F.when(body == "", "empty diagram").when(~known, F.concat(F.lit("unrecognized diagram directive '"), first, F.lit("'")))
    for opens, closes in ("{}", "[]", "()"):
        fault = fault.when(_count(plain, opens) != _count(plain, closes), f"unbalanced {opens}{closes} delimiters")
    return fault


def diagrams(body: Column) -> Column:
    """Inner texts of all diagram blocks."""
    return F.regexp_extract_all(body, F.lit(DIAGRAM), F.lit(1))


def broken_diagrams(body: Column) -> Column:
    return F.filter(F.transform(diagrams(body), diagram_fault), lambda x: x.isNotNull())


def degrade_diagrams(body: Column) -> Column:
    """body with each broken diagram shown as plain text under a note; pieces between diagrams stay as they are."""
    pieces, inner = F.split(body, DIAGRAM, -1), diagrams(body)
    blocks = F.regexp_extract_all(body, F.lit(DIAGRAM), F.lit(0))

    def one(piece: Column, i: Column) -> Column:
        block = F.get(inner, i)
        shown = F.concat(F.lit(FAILURE), diagram_fault(block), F.lit(" -->\n```text\n"), F.regexp_replace(block, r"^\s+|\s+$", ""), F.lit("\n```"))
        return F.concat(piece, F.when(i >= F.size(blocks), "").when(diagram_fault(block).isNull(), F.get(blocks, i)).otherwise(shown))

    return F.array_join(F.transform(pieces, one), "")


def signature(tool: Column, arguments: Column) -> Column:
    """One text for a tool and its arguments (a map of texts): keys in order, memory addresses made alike."""
    ordered = F.array_sort(F.map_entries(arguments))
    return F.concat(tool, F.lit("|"), F.to_json(F.transform(ordered, lambda e: F.struct(e["key"].alias("k"), F.regexp_replace(e["value"], "0x[0-9a-fA-F]+", "0x?").alias("v")))))


def signed_embedder(dimension: int = 64):
    """The test double's embedding: words count one, their trigrams a half, each with the sign of its hash."""

    def one(text: str) -> list[float]:
        import numpy as np

        vector = np.zeros(dimension)
        for word in re.findall(r"[A-Za-z0-9_]+", (text or "").lower()):
            for part, weight in [(word, 1.0), *((word[i : i + 3], 0.5) for i in range(len(word) - 2))]:
                digest = hashlib.sha256(part.encode()).digest()
                vector[int.from_bytes(digest[:4], "big") % dimension] += weight if digest[4] % 2 == 0 else -weight
        if not vector.any():
            vector[:] = 1.0
        return (vector / np.linalg.norm(vector)).tolist()

    @F.pandas_udf("array<double>")
    def embed(text: pd.Series) -> pd.Series:
        return text.map(one)

    return embed


def known_citations(text: Column, ids: Column) -> Column:
    """Cited numbers that aren't among ids."""
    return F.array_except(X.citation_ids(text), ids)


def strip_citations(text: Column, ids: Column) -> Column:
    """text without bracketed citations of a single number that isn't among ids."""
    def without(t: Column, i: Column) -> Column:
        for before, after in ((" [", "]"), ("[", "]"), (" [PMID:", "]"), ("[PMID:", "]")):
            t = F.replace(t, F.concat(F.lit(before), i, F.lit(after)), F.lit(""))
        return t

    return F.aggregate(known_citations(text, ids), text, without)
