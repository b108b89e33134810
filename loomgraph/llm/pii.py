"""Finding and sanitising personal data, in DataFrame functions only.

Base patterns find the protected entities: e-mail addresses, IPv4 addresses, card and phone numbers. An entity
is protected both as a value (one address) and as a class (any address). Co-occurrence over the whole corpus then
estimates how strongly each term reveals an entity, as the share PMI(entity; term) / IC(entity) of the entity's
information that the term discloses. Terms above a first threshold are generalised and those above a second one
removed, wherever they stand in a text that holds the entity.

The one unit of all counts is the different text, so copies count once. Terms are runs of three and more letters,
digits and low lines outside the base spans. A term must share SUPPORT texts with a value, or CLASS_SUPPORT with
a class, to say anything about it. Entities with the same set of texts are counted as one.

Defined results: a null text is empty and has no spans; equal texts get equal spans whatever their ids; an
empty table gives an empty result; further columns are carried by sanitise(). Offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import forget, keep, release
from .common import BROADCAST_ROWS, let, text_of

#: The kinds in order and their patterns. Look-behinds and possessive repeats only keep the
#: matcher from trying again inside a run that has failed, and from recursing; the matches are the same.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every match of a kind contains, a cheap test before the pattern.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"[\p{L}\p{N}_]{3,}"
SUPPORT, CLASS_SUPPORT = 2, 5
RUN = 64
GENERALISE, REMOVE = 0.8, 0.95
PIECE = "array<struct<start:bigint,end:bigint,value:string>>"
SPANS = "array<struct<start:bigint,place:int,end:bigint,kind:string,value:string>>"


def located(text: Column, pattern: str, base: Column | None = None) -> Column:
    """Leftmost non-overlapping matches with code point offsets, end exclusive, moved by base.

    Matches and the pieces between them alternate, so running lengths are the offsets. They run inside chunks of
    RUN matches, whose starts run once more, as an array that grows one by one is copied at each step.
    """
    base = F.lit(0).cast("long") if base is None else base
    empty = F.array().cast(PIECE)

    def offsets(found: Column) -> Column:
        def walk(gaps: Column) -> Column:
            def length(i: Column) -> Column:
                return F.length(F.get(gaps, i)) + F.length(F.get(found, i))

            def places(chunk: Column) -> Column:
                return F.sequence(chunk * RUN, F.least(chunk * RUN + RUN, F.size(found)) - 1)

            def begun(s: Column, chunk: Column) -> Column:
                after = s["at"] + F.aggregate(places(chunk), F.lit(0).cast("long"), lambda n, i: n + length(i))
                return F.struct(after.alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

            def step(s: Column, i: Column) -> Column:
                begin = s["at"] + F.length(F.get(gaps, i))
                one = F.array(F.struct(begin.alias("start"), (s["at"] + length(i)).alias("end"), F.get(found, i).alias("value")))
                return F.struct((s["at"] + length(i)).alias("at"), F.concat(s["out"], one).alias("out"))

            def inside(starts: Column) -> Column:
                def one(at: Column, chunk: Column) -> Column:
                    return F.aggregate(places(chunk), F.struct(at.alias("at"), empty.alias("out")), step, lambda s: s["out"])

                return F.flatten(F.transform(starts, one))

            chunks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int"))
            start = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("out"))
            return let(F.aggregate(chunks, start, begun, lambda s: s["out"]), inside)

        return F.when(F.size(found) == 0, empty).otherwise(let(F.split(text, pattern, -1), walk))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), offsets)


def luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, F.length(digits) - i + 1, F.lit(1))) - 48
        d = F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + d

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """array<struct<start, place, end, kind, value>> by start, then kind as listed."""
    def of_kind(place: int, kind: str, pattern: str) -> Column:
        found = F.filter(located(text, pattern), lambda x: _valid(kind, x["value"]))
        if NEEDS[kind]:
            found = F.when(text.contains(NEEDS[kind]), found).otherwise(F.array().cast(PIECE))
        return F.transform(found, lambda x: F.struct(
            x["start"].alias("start"), F.lit(place).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))

    return F.array_sort(F.concat(*[of_kind(place, kind, pattern) for place, (kind, pattern) in enumerate(PATTERNS.items())]))


def _gaps(text: Column, spans: Column) -> Column:
    """array<struct<start, end>> of what lies between the spans."""
    def step(s: Column, x: Column) -> Column:
        gap = F.array(F.struct(s["at"].alias("start"), x["start"].alias("end")))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] > s["at"], F.concat(s["out"], gap)).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
    last = lambda s: F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), F.length(text).cast("long").alias("end"))))
    return F.aggregate(spans, start, step, last)


def _words(text: Column, spans: Column) -> Column:
    """The different terms outside the spans."""
    part = lambda g: F.substr(text, (g["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int"))
    return F.array_distinct(F.regexp_extract_all(F.array_join(F.transform(_gaps(text, spans), part), " "), F.lit(TERM), F.lit(0)))


def _terms(text: Column, spans: Column) -> Column:
    """Terms outside the spans, with offsets."""
    part = lambda g: located(F.substr(text, (g["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int")), TERM, g["start"])
    return let(_gaps(text, spans), lambda gaps: F.flatten(F.transform(gaps, part)))


def _hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _small(side: DataFrame) -> DataFrame:
    """A kept side, broadcast only if it is counted to be small."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def find(docs: DataFrame) -> DataFrame:
    """th (the text's hash), t, spans (base) of each different text; kept."""
    rows = docs.select(text_of().alias("t")).select(_hash(F.col("t")).alias("th"), "t").dropDuplicates(["th"])
    found = keep(rows.select("th", "t", base_spans(F.col("t")).alias("spans")))
    release(docs.sparkSession)
    return found


def disclosed(found: DataFrame, support: int = SUPPORT, class_support: int = CLASS_SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """th, terms: in each different text the spans of terms that disclose an entity of that text; kept."""
    held = keep(found.where(F.size("spans") > 0).select("th", "t", "spans", _words(F.col("t"), F.col("spans")).alias("words")))
    values = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["value"]))
    named = F.array_distinct(F.concat(values, F.transform("spans", lambda s: s["kind"])))
    mentions = held.select("th", F.explode(named).alias("entity"))
    # Entities by their sets of texts, told apart by size and two sums of hashes.
    prints = (F.bit_xor(F.xxhash64("th")).alias("x"), F.sum(F.pmod(F.xxhash64("th", F.lit(1)), F.lit(1 << 31))).alias("y"))
    least = F.when(F.instr("entity", ":") > 0, F.lit(support)).otherwise(F.lit(class_support))
    sets = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("texts"), *prints).withColumn("least", least).where("texts >= least")
    sets = keep(sets.select("entity", "texts", F.concat_ws(":", "texts", "x", "y").alias("set"), "least"))
    members = keep(mentions.join(_small(sets.select("entity", "set")), "entity").select("th", "set").distinct())
    kinds = sets.groupBy("set").agg(F.min("least").alias("least"), F.first("texts").alias("texts"))
    words = members.join(held.select("th", "words"), "th")
    pairs = words.select("set", F.explode("words").alias("term")).groupBy("set", "term").agg(F.count(F.lit(1)).alias("together"))
    pairs = keep(pairs.join(_small(keep(kinds)), "set").where("together >= least"))
    # How many different texts hold each wanted term, over the whole corpus.
    wanted = keep(pairs.select("term").distinct())
    seen = found.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(TERM), F.lit(0)))).alias("term"))
    # Counted before the join, which is no semi join as Spark would move that below the counting: what moves are the
    # different words of each task, at every size.
    in_texts = seen.groupBy("term").agg(F.count(F.lit(1)).alias("with_term")).join(_small(wanted), "term")
    n = F.lit(float(max(found.count(), 1)))
    information = F.log(n / F.col("texts"))
    pmi = F.log(F.col("together") * n / (F.col("texts") * F.col("with_term")))
    scored = pairs.join(in_texts, "term").withColumn("share", F.when(information > 0, pmi / information).otherwise(F.lit(0.0)))
    action = F.when(F.col("share") >= remove, "remove").otherwise("generalise")
    telling = keep(scored.where(F.col("share") >= generalise).select("set", "term", action.alias("action")))
    hits = words.select("th", "set", F.explode("words").alias("term")).join(_small(telling), ["set", "term"])
    hits = keep(hits.groupBy("th", "term").agg(F.max("action").alias("action")))
    # Only texts that hold a telling term are searched for its places.
    told = keep(held.join(_small(keep(hits.select("th").distinct())), "th", "left_semi").select("th", _terms(F.col("t"), F.col("spans")).alias("terms")))
    marks = told.select("th", F.explode("terms").alias("x")).select("th", F.col("x.value").alias("term"), "x.start", "x.end").join(_small(hits), ["th", "term"])
    one = F.struct("start", F.lit(len(PATTERNS)).alias("place"), "end", F.lit("term").alias("kind"), F.col("action").alias("value"))
    marks = keep(marks.groupBy("th").agg(F.collect_list(one).alias("terms")))
    forget(held, sets, members, pairs, wanted, telling, hits, told)
    return marks


def spans_by_text(docs: DataFrame) -> DataFrame:
    """th, base, spans (base and terms, sorted) of each different text that has any; kept."""
    found = find(docs)
    marks = disclosed(found)
    rows = found.where(F.size("spans") > 0).select("th", F.col("spans").alias("base"))
    whole = F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(SPANS))))
    both = keep(rows.join(_small(marks), "th", "left").select("th", "base", whole.alias("spans")))
    forget(found, marks)
    return both


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, a digest of the base spans and all spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    names = [f"n_{kind}" for kind in PATTERNS]
    digest = F.sha2(_joined(F.col("base")).cast("binary"), 256)
    by_text = keep(spans_by_text(docs).select("th", *map(count, PATTERNS), digest.alias("base_sha256"), _joined(F.col("spans")).alias("spans")))
    rows = docs.select("doc_id", _hash(text_of()).alias("th")).join(_small(by_text), "th", "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return rows.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names], F.coalesce("base_sha256", empty).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with every span replaced: entities by their kind, terms generalised or removed."""
    columns = docs.columns
    marks = spans_by_text(docs).select(F.col("th").alias("_th"), F.col("spans").alias("_spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), text_of().alias("_t"))
    rows = rows.withColumn("_h", _hash(F.col("_t"))).join(_small(marks), F.col("_h") == F.col("_th"), "left")

    def rewritten(spans: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            name = F.when(x["kind"] != "term", F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))).when(x["value"] == "remove", "").otherwise("<TERM>")
            plain = F.substr("_t", (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
            fresh = F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(plain, name)).alias("out"))
            return F.when(x["start"] >= s["at"], fresh).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out")))

        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
        rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substr("_t", (s["at"] + 1).cast("int"), F.length("_t")))
        return F.aggregate(spans, start, step, rest)

    text = F.when(F.size("_spans") > 0, rewritten(F.col("_spans"))).otherwise(F.col("_row.text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in columns])
