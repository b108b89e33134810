"""Quality rules in DataFrame functions only: base counts and a hashed n-gram likelihood ratio.

Words and pairs of words are hashed into a fixed number of features. Two multinomials over the features are
counted, one from trusted rows and one from the whole corpus; a document's score is the mean over its
features of log(trusted / corpus). The threshold is the score that all but LEFT_OUT of the trusted documents reach;
every document with a score of at least that is kept, and nothing is drawn at random.

Defined results: a null text has no words and fails the base rule; documents without words score 0; repeated
rows get equal verdicts; an empty corpus gives an empty result; without trusted rows all scores and the threshold
are 0. Further columns are carried, those with the names of results are replaced. The ratio table has a fixed number of entries whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import forget, keep
from .common import WORD, let, text_of, words

FEATURES = 4096
#: The share of trusted documents below the threshold, and the least words of a document that counts for it.
LEFT_OUT, LEAST_WORDS = 0.001, 50
#: Bits that say which hashed ids may be trusted, in rows of 32,768: 4 MB to broadcast, however many ids there are.
ID_BITS = 1 << 25
SYMBOLS = r"[#*$%&|<>]"


def hashed(word_list: Column) -> Column:
    return F.transform(word_list, lambda w: F.xxhash64(w))


def features(hashes: Column, size: int = FEATURES) -> Column:
    """Feature numbers of the words and of the pairs of neighbouring words, the last word paired with the end."""
    after = F.slice(hashes, 2, F.size(hashes))
    single = F.transform(hashes, lambda a: F.pmod(a, F.lit(size)))
    return F.concat(single, F.zip_with(hashes, after, lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(size))))


def n_repeat_words(hashes: Column) -> Column:
    """Words inside three-word windows that the text holds at least twice, from 64-bit hashes of the words."""
    n = F.size(hashes)

    def covered(grams: Column) -> Column:
        marked = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(m: Column) -> Column:
            again = F.filter(m, lambda x, i: ((i > 0) & (F.get(m, i - 1)["g"] == x["g"])) | F.coalesce(F.get(m, i + 1)["g"] == x["g"], F.lit(False)))
            spread = F.flatten(F.transform(again, lambda x: F.sequence(x["i"], x["i"] + 2)))
            return F.size(F.array_distinct(spread)).cast("long")

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(marked, places))

    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(grams, covered))


def ratio(hashes: Column, table: Column | None, size: int = FEATURES) -> Column:
    """Mean over the features of their log ratios."""
    if table is None:
        return F.lit(0.0)
    return let(features(hashes, size), lambda f: F.aggregate(f, F.lit(0.0), lambda a, x: a + F.get(table, x.cast("int"))) / F.greatest(F.size(f), F.lit(1)))


def measured(text: Column, table: Column | None = None, threshold: float = 0.0, size: int = FEATURES) -> Column:
    """struct of the base columns, llr, base_failed and kept.

    One expression over the text: the word hashes are a lambda's variable, so no rewrite of the plan (a filter on
    kept, say) computes them again for each word.
    """
    def lines(x: Column) -> Column:
        return (F.size(x) - F.size(F.array_distinct(x))).cast("long")

    def counts(h: Column) -> Column:
        return F.struct(
            F.size(h).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lines).alias("n_dup_lines"),
            n_repeat_words(h).alias("n_repeat_words"), ratio(h, table, size).alias("llr"))

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < LEAST_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)
        return F.struct(*[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr")],
                        failed.alias("base_failed"), (~failed & (m["llr"] >= threshold)).alias("kept"))

    return let(let(hashed(words(text)), counts), verdict)


def trusted_rows(docs: DataFrame, ids: DataFrame, bits: int = ID_BITS) -> DataFrame:
    """All rows of docs with a doc_id of ids.

    Bits of hashed ids, a broadcast of fixed size, drop most other rows before the exact join, so that few texts
    besides the trusted ones are shuffled. More ids than bits only let more rows through to the exact join.
    """
    some = ids.select("doc_id").where("doc_id is not null")

    def slot(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(bits))

    # Names of its own, also beside a caller's columns of these names.
    n_slot, n_bucket, n_bits = (unused(name, docs.columns) for name in ("_slot", "_bucket", "_bits"))
    marks = some.select(slot("doc_id").alias(n_slot)).groupBy(F.bitmap_bucket_number(n_slot).alias(n_bucket))
    marks = marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position(n_slot)).alias(n_bits))
    byte = F.conv(F.hex(F.expr(f"substring({n_bits}, cast(bitmap_bit_position({n_slot}) div 8 + 1 as int), 1)")), 16, 10).cast("long")
    maybe = docs.withColumn(n_slot, slot("doc_id")).withColumn(n_bucket, F.bitmap_bucket_number(n_slot)).join(F.broadcast(marks), n_bucket)
    maybe = maybe.where(F.getbit(byte, (F.bitmap_bit_position(n_slot) % 8).cast("int")) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    # An inner join with distinct ids: Spark would move a semi join below the filter by bits.
    return maybe.join(some.distinct().hint("shuffle_hash"), "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns])


def unused(name: str, columns: list[str]) -> str:
    """name, with as many further underscores as keep it apart from columns (whatever their case)."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def log_ratios(docs: DataFrame, trusted: DataFrame, size: int = FEATURES) -> list[float]:
    """log(trusted / corpus) by feature; size numbers, whatever the corpus.

    The corpus gets one count more in each feature; the trusted counts get `size` counts more, shared out as the
    corpus is, so that few trusted rows give ratios near 1 and not zeros.
    """
    def counted(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(features(hashed(words(text_of())), size)).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))

    both = counted(docs).withColumnRenamed("n", "raw").join(counted(trusted).withColumnRenamed("n", "good"), "f", "full")
    found = both.collect()  # at most `size` rows
    raw, good = [1.0] * size, [0.0] * size
    for row in found:
        raw[int(row.f)] += row.raw or 0
        good[int(row.f)] += row.good or 0
    all_raw, all_good = sum(raw), sum(good) + size
    return [round(math.log((g + size * r / all_raw) / all_good * all_raw / r), 6) for g, r in zip(good, raw)]


def threshold_of(trusted: DataFrame, table: Column, size: int = FEATURES, left_out: float = LEFT_OUT) -> float:
    """The score, rounded down to thousandths, that all but a share of the trusted rows reach.

    Only a histogram of the scores comes here: a row for each thousandth between the least and the largest ratio.
    """
    scored = trusted.select(let(hashed(words(text_of())), lambda h: F.when(F.size(h) >= LEAST_WORDS, ratio(h, table, size))).alias("llr")).where("llr is not null")
    counts = sorted((r["bin"], r["n"]) for r in scored.groupBy(F.floor(F.col("llr") * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect())
    below, most = 0, left_out * sum(n for _, n in counts)
    for step, n in counts:
        below += n
        if below > most:
            return step / 1000
    return 0.0


def _rule(docs: DataFrame, trusted: DataFrame, threshold: float | None, size: int) -> Column:
    trusted = keep(trusted.select("text"))  # counted and then scored
    table = F.split(F.lit(",".join(map(str, log_ratios(docs, trusted, size)))), ",").cast("array<double>")
    rule = measured(text_of(), table, threshold_of(trusted, table, size) if threshold is None else threshold, size)
    forget(trusted)
    return rule


def judge(docs: DataFrame, trusted: DataFrame, threshold: float | None = None, size: int = FEATURES) -> DataFrame:
    """docs with the base columns, llr, base_failed and kept. trusted: rows with text to resemble."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")
    rest = [c for c in docs.columns if c not in names]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_row"), _rule(docs, trusted, threshold, size).alias("_found"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in rest], *[F.col("_found")[c].alias(c) for c in names])


def passing(docs: DataFrame, trusted: DataFrame, threshold: float | None = None, size: int = FEATURES) -> DataFrame:
    """The rows of docs that are kept, unchanged."""
    return docs.where(_rule(docs, trusted, threshold, size)["kept"])
