"""The operators written in DataFrame functions, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import mixing, pii, quality_rules, sharding

DOCS = "doc_id long, text string, source string, lang string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(None, None, None, None), (None, "", "src0", None), (7, "twice", "src1", "x"), (7, "twice", "src1", "x"), (10**12, "é ü 日本 x" * 3000, None, "y"), (-5, "a\t\x0b b\x1cc", "z", "y")]
    return spark.createDataFrame(rows, DOCS)


def plans(frame):
    return frame._jdf.queryExecution().toString()


# --- personal data ---

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def spans_of(text):
    out = []
    for place, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
            fine = {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if fine[kind]:
                out.append((m.start(), place, m.end(), kind))
    return sorted(out)


ODD = ["a@b.c_d@e.f x@y.z@q.w", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 x 4111-1111-1111-1112", "+1 (743) 555-3824.+12 34", "", None, "é@b.co ñ 1.1.1.1", "9" * 20000, "a" * 50000, "a.b@" * 3000, "1." * 5000, "$1 \\ ^ a@b.cd"]


def test_base_spans_equal_plain_regexes(spark, docs):
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = {(r.doc_id, r.text) for r in rows.collect()}
    got = pii.report(rows).collect()
    assert len(got) == rows.count()
    expected = Counter()
    for doc_id, text in [tuple(r) for r in rows.collect()]:
        found = spans_of(text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in found).encode()).hexdigest()
        expected[doc_id, digest, *(sum(k == kind for *_, k in found) for kind in PATTERNS)] += 1
    assert texts and Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == expected


def test_terms_of_an_entity_are_removed_and_clean_texts_stay(spark):
    rows = [(i, f"No {i} says: ask melchior at mz@corp.org, {'word ' * (i + 20)} or Melchior") for i in range(6)] + [(100 + i, f"Plain person {i} says nothing. Ask No one") for i in range(40)]
    clean = dict(rows[6:])
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("elchior" not in got[i] and "<EMAIL>" in got[i] and "says" in got[i] for i in range(6))
    assert all(got[i] == t for i, t in clean.items())
    report = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:" in report[0] and report[100] == ""


def test_no_python_in_the_native_plans(docs):
    frames = [sharding.layout(docs, 4), quality_rules.judge(docs, docs), pii.report(docs.select("doc_id", "text")), mixing.plan(docs)]
    assert not any(re.search("Python|Pandas|Arrow", plans(f)) for f in frames)


# --- quality rules ---


def base_of(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_base_counts(docs):
    got = quality_rules.judge(docs, docs.limit(0))
    rows = got.collect()
    assert len(rows) == docs.count() and set(docs.columns) < set(got.columns)
    for r in rows:
        base = base_of(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and r.kept == (not r.base_failed)


def test_quality_ratio_equals_plain_counts(spark, sf):
    import math

    import xxhash

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    good = quality_rules.trusted_rows(docs, spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"))

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def hashes(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
        pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
        end = [xxhash.xxh64_intdigest(h[-1].to_bytes(8, "little"), 42)] if h else []
        return [signed(x) % quality_rules.FEATURES for x in [*h, *pairs, *end]]

    raw, trusted, size = Counter(), Counter(), quality_rules.FEATURES
    texts = {r.doc_id: hashes(r.text) for r in docs.collect()}
    for f in texts.values():
        raw.update(f)
    for r in good.collect():
        trusted.update(texts[r.doc_id])
    n, m = sum(raw.values()) + size, sum(trusted.values()) + size
    table = [math.log((trusted[f] + size * (raw[f] + 1) / n) / m * n / (raw[f] + 1)) for f in range(size)]
    for r in quality_rules.judge(docs, good).collect():
        f = texts[r.doc_id]
        assert abs(r.llr - sum(table[x] for x in f) / max(len(f), 1)) < 1e-5


def test_quality_trusts_every_labelled_row(spark):
    """More ids than the 16,384 once used, with many bits and with few: the rows are exactly those asked for."""
    docs = spark.range(60_000).selectExpr("id as doc_id", "'a b' as text").union(spark.createDataFrame([(None, "a"), (3, "again")], "doc_id long, text string"))
    ids = spark.range(20_000).selectExpr("id * 3 as doc_id").union(spark.createDataFrame([(None,), (3,), (10**12,)], "doc_id long"))
    for bits in ((), (1 << 15,)):
        got = Counter(r.doc_id for r in quality_rules.trusted_rows(docs, ids, *bits).collect())
        assert got == Counter([*range(0, 60_000, 3), 3])


def test_quality_trusted_rows_beside_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "x", 7, "b"), (2, "c", "y", 8, "d")], "doc_id long, text string, _bits string, _SLOT int, _bucket string")
    got = quality_rules.trusted_rows(docs, spark.createDataFrame([(1,), (None,)], "doc_id long"))
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "a", "x", 7, "b")]


def test_quality_keeps_labelled_clean_and_drops_most_junk(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.judge(docs, quality_rules.trusted_rows(docs, labels.where("quality = 1"))).join(labels, "doc_id").where("not base_failed")
    share = {r.quality: r.k for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.99 and share[0] < 0.3


# --- mixing ---


def filled(sizes):
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left, total = {}, dict(weights), float(sum(sizes.values()))
    while left:
        level = (total - sum(target.values())) / sum(left.values())
        over = [s for s in left if level * weights[s] > 3 * sizes[s] + 1e-9]
        if not over:
            target |= {s: level * left[s] for s in left}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            del left[s]
    return target


def test_mixing_meets_targets(docs):
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size and 0 <= r.position <= 1
    expected = filled(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6 * max(1, r.target)
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - expected[s]) <= largest / 2 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(docs.repartition(5)).collect()))


def test_mixing_cap_and_hot_source(spark):
    rows = [(i, "w " * (1 + i % 7), "big", "x") for i in range(3000)] + [(5000, "a b", "tiny", "x"), (5001, None, None, None), (5002, "one", "zz", None)]
    out = mixing.plan(spark.createDataFrame(rows, DOCS)).collect()
    by = {r.source: r for r in out}
    assert by["tiny"].target == 6.0 and by["tiny"].taken == 6 and by["zz"].taken == 3 and by[None].taken == 0
    assert abs(sum(r.taken for r in out) - sum(r.size for r in out)) < 10


def test_mix_rows_follow_the_plan(docs):
    planned = {}
    for r in mixing.plan(docs).collect():
        planned[r.doc_id] = planned.get(r.doc_id, 0) + r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in planned.items() if v})


def test_invert_is_the_inverse_of_the_integral(spark):
    for schedule in mixing.SCHEDULES:
        for t in (0.0, 0.1, 0.5, 0.77, 1.0):
            steps = [i * t / 2000 for i in range(2001)]

            def w(x, schedule=schedule):
                k = min(int(x * 2), 1)
                return schedule[k] + (schedule[k + 1] - schedule[k]) * (x * 2 - k)

            area = sum((w(a) + w(b)) / 2 * (b - a) for a, b in zip(steps, steps[1:]))
            got = spark.range(1).select(mixing.invert(schedule, F.lit(area / 1.0))).first()[0]
            assert abs(got - t) < 1e-3


# --- sharding ---


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding_equals_the_published_function(spark, docs):
    keys = spark.createDataFrame([(k,) for k in (0, 1, -1, 2**63 - 1, -(2**63), None, *range(100, 160))], "k long")
    for r in keys.select("k", sharding.jump_shards(F.col("k"), 16).alias("x")).collect():
        assert (r.x.now, r.x.grown) == (jump(r.k or 0, 16), jump(r.k or 0, 17))
    rows = sharding.layout(docs, 16).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert sharding.layout(empty, 4).count() == 0
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert pii.report(empty).count() == 0 and pii.sanitise(empty).columns == empty.columns
    assert quality_rules.judge(empty, empty).count() == 0


def test_clashing_column_names(spark):
    rows = spark.createDataFrame([(1, "Ask at a@b.cd " * 20, "s", 1, 2, 3)], "doc_id long, text string, source string, spans int, size int, terms int")
    assert pii.sanitise(rows).columns == rows.columns and pii.sanitise(rows).count() == 1
    assert mixing.mix(rows).columns == rows.columns and sharding.layout(rows, 3).count() == 1
    assert quality_rules.judge(rows, rows).count() == 1
