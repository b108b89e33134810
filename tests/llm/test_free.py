"""The operators that use Python workers, against brute force, round trips and held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import lm_scoring, minhash, neighbours, packing, quality_classifier, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(None, None), (10**6, ""), (7, "twice same"), (7, "twice same"), (10**6 + 1, "é ü 日本 " * 4000), (10**6 + 2, "a\t\x0b b\x1cc"), (10**6 + 3, None), (10**6 + 4, "a <|endoftext|> b<|endoftext|>c<|startoftext|>")]
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- neighbours ---


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 16))
    x[100:400] = x[100]  # a crowd of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16), (5080, [1.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.search(frame, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        score = np.zeros(len(x))
        for d in range(16):
            score += x[q, d] * x[:, d]
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score))[:20]
        hits += len(set(best) & {v for _, v, _ in found})
        assert [k for k, *_ in found] == list(range(1, 21))
        assert all(s == score[v] for _, v, s in found) and found == sorted(found, key=lambda t: (-t[2], t[1]))
    assert hits / (20 * len(got)) >= 0.9


def test_neighbours_of_repeated_rows_and_with_further_columns(spark):
    x = np.random.default_rng(2).standard_normal((60, 4)).tolist()
    rows = [(i, v, 1, [0]) for i, v in enumerate(x)] + [(20, x[20], 2, [1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, p int, parts array<int>")
    got = neighbours.search(frame, F.col("vec_id") % 20 == 0).collect()
    assert Counter(r.query_id for r in got) == {0: 20, 20: 40, 40: 20}
    own = [r for r in got if r.query_id == 20 and r.vec_id == 20]
    assert len(own) == 2 and all(r.score == pytest.approx(sum(a * a for a in x[20])) for r in own)


def test_neighbours_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    rows = neighbours.search(frame, F.col("vec_id") % 20 == 0).collect()
    assert Counter(r.query_id for r in rows) == {0: 2, 20: 2}
    assert neighbours.search(frame.limit(0), F.lit(True)).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(1).standard_normal((512, 8))
    label = neighbours.balanced_parts(neighbours.neighbour_graph(x, 8), 8)
    assert np.bincount(label).tolist() == [64] * 8


# --- repeated windows ---


def repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        marks = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                marks[i] += 1
                marks[i + length] -= 1
        gone = np.cumsum(marks)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_windows_equal_brute_force(spark):
    rng = random.Random(5)

    def noise(n):
        return "".join(rng.choice("abcdeé \n") for _ in range(n))

    shared = [noise(900) for _ in range(4)]
    texts = [noise(300) + rng.choice(shared)[rng.randint(0, 300) : rng.randint(500, 900)] + noise(rng.randint(0, 500)) for _ in range(30)]
    texts += ["a" * 1500, "ab" * 900, "xyz" * 200, None, "", noise(399), noise(400), shared[0], shared[0], "q" * 401]
    marked = "".join("Z" if i % 611 == 0 else c for i, c in enumerate(texts[3]))
    texts += [marked, marked, texts[4][:1000] + "!" + texts[4][1000:]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(frame).collect()}
    assert [got[i] for i in range(len(texts))] == repeats(texts, 400)


def test_repeats_are_cut_from_texts(spark, docs):
    frame = spark.createDataFrame([(1, "x" * 50 + "".join(map(str, range(300)))), (2, "".join(map(str, range(300)))), (3, None), (3, "k")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in suffix_dedup.without_repeats(frame).collect()), key=str) == sorted([(1, "x" * 50), (2, ""), (3, None), (3, "k")], key=str)
    assert suffix_dedup.report(docs.limit(0)).count() == 0 and suffix_dedup.report(docs).count() == docs.count()


# --- packing ---


@pytest.fixture(scope="module")
def path():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("word_bpe_49k.json")


def test_plain_and_known_words_are_not_encoded_again(path, monkeypatch):
    from tokenizers import Tokenizer

    class Counting:
        def __init__(self, inner):
            self.inner, self.model, self.calls = inner, inner.model, 0

        def encode(self, *args, **more):
            self.calls += 1
            return self.inner.encode(*args, **more)

    true = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "CACHE_WORDS", 8)
    known = packing._tokenizers[path] = packing._Words(path)
    known.tokenizer = counting = Counting(known.tokenizer)
    texts = ["Ñandú,&&& ÀÍÿ*** Straße. abc<|", "it's 4x", "ab ac ad ae", "", "\tit's\x0bab ag \n"]
    calls = []
    try:
        for text in texts:
            assert [np.frombuffer(x, "<u4").tolist() for x in packing.token_bytes([text], path)] == [true.encode(text, add_special_tokens=False).ids + [0]]
            calls.append(counting.calls)
    finally:
        del packing._tokenizers[path]
    assert calls == [0, 1, 1, 1, 1] and known.older


def test_tokens_equal_the_tokenizer(docs, path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    texts = [r.text or "" for r in docs.collect()] + ["a b\x1cc  d\te　f", "é é ́x", "İstanbul ΣΑΣ ΟΔΟΣ x", "<|endoftext|> it's I'LL\n\n x", "a" * 3000, "\x85q z", "a,, b., c!? d...", "Word, wORD. x9, 9, don't,"]
    for text, got in zip(texts, packing.token_bytes(texts, path)):
        assert np.frombuffer(got, "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]


def test_sequences_are_gapless_and_hold_every_piece(docs, path):
    rows = packing.packed(docs, path).collect()
    ids = {}
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    expected = Counter()
    for (doc_id, text), raw in zip(texts, packing.token_bytes([t for _, t in texts], path)):
        ids[doc_id] = raw
        for piece, at in enumerate(range(0, len(raw), 8192)):
            part = raw[at : at + 8192]
            expected[doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(bins) <= least * 1.02 + 1
    assert packing.packed(docs.limit(0), path).count() == 0


def test_pack_keeps_every_piece_and_search_helps():
    rng = random.Random(1)
    for _ in range(200):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 80)))
        groups = packing.pack(counts, 40)
        got = Counter()
        for items, many in groups:
            assert sum(items) <= 40 and many > 0
            for i in items:
                got[i] += many
        assert got == counts
    assert len(packing._improve([[6, 4], [5, 3], [5, 3], [4]], 10, 100)) == 3


def test_search_reaches_every_bin_of_every_group():
    # Best fit takes 500 bins: 300 of (819, 819) and 200 of (614, 614, 614).
    assert sum(many for _, many in packing.pack({819: 600, 614: 600}, 2048)) == 450
    # The two that gain are not among the 64 longest.
    assert packing._step([20] * 64 + [6, 5], [2036, 10], 2) == ([6, 5], [10])
    rng = random.Random(2)
    for _ in range(100):
        counts = Counter(rng.randint(5, 39) for _ in range(rng.randint(1, 60)))
        groups = packing.pack({k: 7 * n for k, n in counts.items()}, 40)
        got = Counter()
        for items, many in groups:
            assert sum(items) <= 40 and many > 0
            for i in items:
                got[i] += many
        assert got == {k: 7 * n for k, n in counts.items()}
        if sum(many for _, many in groups) > -(-sum(k * n for k, n in got.items()) // 40):
            slack = [(i, n) for i, n in groups if sum(i) < 40]
            assert not any(packing._step(x, y, 40 - sum(y)) for x, n in slack for y, _ in slack if sum(x) <= sum(y) and (x != y or n > 1))


# --- quality classifier ---


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = quality_classifier.held_out()
    model = quality_classifier.fit(docs, labels.where(~held))
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(None, None), (-1, ""), (-2, "y" * 300_000)], "doc_id long, text string"))
    scored = quality_classifier.score(more, model)
    assert scored.count() == more.count() and scored.where("score between 0 and 1").count() == more.count()
    rows = scored.join(labels, "doc_id").where(held).collect()
    right = sum((r.score >= 0.7) == (r.quality == 1) for r in rows)
    assert right / len(rows) > 0.9


def test_classifier_gradients():
    rng = np.random.default_rng(0)
    net = quality_classifier.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, starts = rng.integers(0, 256, (4, quality_classifier.CHUNK)).astype(np.uint8), np.array([0, 3])
    labels, weight = np.array([1.0, 0.0]), np.ones(2)

    def loss():
        p = net.probability(net.combine(net.best(rows), starts))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = net._gradients(rows, starts, labels, weight)
    for name, at in (("filters", (5, 3)), ("bias", (2,)), ("dense", (40,)), ("embed", (17, 2)), ("offset", (0,))):
        before = net.p[name][at]
        net.p[name][at] = before + 1e-5
        up = loss()
        net.p[name][at] = before - 1e-5
        down = loss()
        net.p[name][at] = before
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-4


def test_chunks_cover_the_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = bytes(rng % 251 + 1 for rng in range(n))
        cut = quality_classifier.chunks(data)
        step = quality_classifier.CHUNK - quality_classifier.OVERLAP
        whole = np.zeros(step * (len(cut) - 1) + quality_classifier.CHUNK, np.uint8)
        for i, row in enumerate(cut):
            whole[i * step : i * step + len(row)] = row
        assert whole[:n].tobytes() == data and not whole[n:].any()


def test_classifier_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.fit(docs, labels) == 0.5
    assert {r.score for r in quality_classifier.score(docs, 0.5).collect()} == {0.5}


# --- language model ---


def _one_trie(texts, order=lm_scoring.ORDER):
    """Counts by context (a tuple of byte values, farthest first) of all orders, in one dict."""
    trie = {}
    for text in texts:
        symbols = [lm_scoring.BEFORE] * order + list(text.encode().lower()) + [lm_scoring.END]
        for i in range(order, len(symbols)):
            for k in range(order + 1):
                node = trie.setdefault(tuple(symbols[i - k : i]), {})
                node[symbols[i]] = node.get(symbols[i], 0) + 1
    return trie


def _ppm(trie, context, symbol):
    """Probability of a symbol after a context, by the definition."""
    p, excluded = 1.0, set()
    for k in range(len(context), -1, -1):
        node = {s: n for s, n in trie.get(tuple(context[len(context) - k :]), {}).items() if s not in excluded}
        if not node:
            continue
        whole = sum(node.values()) + len(node)
        if symbol in node:
            return p * node[symbol] / whole
        p *= len(node) / whole
        excluded |= node.keys()
    return p / (lm_scoring.SYMBOLS - len(excluded))


def _expected(rows):
    trained = [t or "" for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    trie = _one_trie(trained)
    counts = Counter(w for t in trained for w in [*t.encode().lower().split(), b""])
    total, out = sum(counts.values()), []
    for doc_id, text in rows:
        symbols = [lm_scoring.BEFORE] * lm_scoring.ORDER + list((text or "").encode().lower()) + [lm_scoring.END]
        ppm = sum(math.log10(_ppm(trie, symbols[i - lm_scoring.ORDER : i], symbols[i])) for i in range(lm_scoring.ORDER, len(symbols)))
        some = [*(text or "").encode().lower().split(), b""]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in some)
        out.append((doc_id, len(some), sum(counts[w] > 0 for w in some), total, base, ppm))
    return out


def _near(got, expected):
    key = lambda r: (r[0] is None, r[0] or 0, round(r[5], 3))
    for g, e in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert g[:4] == e[:4]
        assert g[4] == pytest.approx(e[4], rel=1e-9) and g[5] == pytest.approx(e[5], rel=1e-6)


@pytest.mark.parametrize("block_bytes", [1500, 1 << 20])
def test_scores_equal_one_trie(spark, block_bytes):
    import random

    words = "the cat sat on a mat \u00e9t\u00e9 \u4e2d\u6587 Don't x1 of\x0bthe".split(" ")
    pick = random.Random(4)
    rows = [(i, " ".join(pick.choices(words, k=pick.randrange(40)))) for i in range(60)]
    rows += [(3, rows[3][1]), (None, "a  spaced\n\ttext "), (None, None), (70, ""), (71, "\U0001f600" * 3), (72, "z" * 200), (9, "never seen Q")]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, block string, bucket int")
    got = lm_scoring.score(docs, lm_scoring.in_training(), block_bytes=block_bytes).collect()
    _near([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], _expected(rows))


def test_scores_depend_on_the_order_of_words(spark):
    rows = [(i, "one two three four five") for i in range(20)] + [(100, "five four three two one")]
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] > got[100] + 3


def test_scores_without_training_or_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(docs, F.lit(False)).collect()}
    assert got[1].score == pytest.approx(-3 * math.log10(lm_scoring.SYMBOLS)) and got[2].base_score == 0 and got[2].n_known == 0
    assert lm_scoring.score(docs.limit(0)).count() == 0


def test_symbols_of_a_context_add_up_to_one():
    texts = ["abra cadabra", "abracadabra", "a bra"]
    data = lm_scoring.joined(texts)
    codes, counts = lm_scoring.counted(lm_scoring.strings(data), lm_scoring.strings(data))
    low = lm_scoring.low_levels(*lm_scoring._summed((codes >> np.uint64(32) << np.uint64(8)) | (codes & np.uint64(255)), counts))
    for context in (b"dabra", b"zzzzz", b"zabra", b"\xfe\xfe\xfeab"):
        base = int.from_bytes(context, "little")  # the nearest byte is the most significant
        every = np.array([base << 8 | s for s in range(256) if s != lm_scoring.BEFORE], np.uint64)
        all_codes = np.unique(np.concatenate([codes, every]))
        found = np.zeros(len(all_codes), np.int64)
        found[np.searchsorted(all_codes, codes)] = counts
        got = lm_scoring.costs(all_codes, found, low)[np.searchsorted(all_codes, every)]
        assert sum(10**got) == pytest.approx(1)


# --- near duplicates ---


def sets_of(rows):
    out = []
    for _, text in rows:
        w = WORD.findall(text or "")
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def classes(rows, similarity=0.8):
    sets, parent = sets_of(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared, where = Counter(), defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for members in where.values():
        shared.update((a, b) for k, a in enumerate(members) for b in members[k + 1 :])
    pairs = [(a, b) for (a, b), n in shared.items() if n >= similarity * (len(sets[a]) + len(sets[b]) - n)]
    first = {}
    pairs += [(first.setdefault(t or "", i), i) for i, (_, t) in enumerate(rows)]
    for a, b in pairs:
        parent[find(b)] = find(a)
    return [find(i) for i in range(len(rows))]


def near_rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 150)))) for i in range(40)]
    for i in range(40):  # a crowd around one text, at many distances from it and from one another
        text = base.copy()
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = f"edit{rng.random()}"
        rows.append((100 + i, " ".join(text)))
    return [*rows, (None, None), (300, ""), (301, " "), (302, "a b"), (303, "a  b"), (304, "a b c"), (100, " ".join(base))]


def test_classes_equal_brute_force(spark, docs):
    for rows in (near_rows(), [(r.doc_id, r.text) for r in docs.collect()]):
        found, _ = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        groups = defaultdict(list)
        for (doc_id, text), c in zip(rows, classes(rows)):
            groups[c].append((doc_id, text))
        expected = Counter()
        for members in groups.values():
            ids = [i for i, _ in members if i is not None]
            for doc_id, _ in members:
                expected[doc_id, min(ids, default=None)] += 1
        assert Counter((r.doc_id, r.class_id) for r in found.collect()) == expected
        kept = minhash.without_copies(spark.createDataFrame(rows, "doc_id long, text string"))
        assert kept.count() == len(groups)


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(30):
        elements = rng.integers(0, 1 << 63, 150).astype(np.uint64)
        a, b = rng.random(150) * 3, rng.random(150) * 3
        s = minhash.dart_minhash(np.concatenate([elements, elements]), np.concatenate([a, b]), np.repeat([0, 1], 150), 2, 192)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_near_duplicates_of_nothing(spark, docs):
    found, links = minhash.near_duplicates(docs.limit(0))
    assert found.count() == 0 and links.count() == 0
