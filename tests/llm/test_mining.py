"""Hard negatives, the prefix trie and token files against brute force and exact round trips."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import hard_negatives, prefix_trie, queries, token_files

# --- hard negatives ---


def mined(frame):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.mine(frame, label, F.col("vec_id") % 100 == 0).collect())


def all_scores(rows):
    width = max(len(v) for _, v, _ in rows if v is not None)
    fine = [r for r in rows if None not in r and all(c is not None and math.isfinite(c) for c in r[1])]
    x = np.array([[math.floor(float(c) * 256) for c in v] + [0] * (width - len(v)) for _, v, _ in fine], np.int64)
    ids, labels = np.array([r[0] for r in fine]), np.array([(r[2] + 1) % 10 if r[0] % 7 == 0 else r[2] for r in fine])
    out = []
    for a in np.flatnonzero(ids % 100 == 0):
        s = x @ x[a]
        order = np.lexsort((ids, -s))
        for p in [j for j in order if j != a and labels[j] == labels[a]][:5]:
            hard = [j for j in order if labels[j] != labels[a] and 80 * s[p] <= 100 * s[j] <= 100 * s[p]][:5]
            out += [(int(ids[a]), int(ids[p]), k + 1, int(ids[j]), int(s[p]), int(s[j])) for k, j in enumerate(hard)]
    return sorted(out)


def test_hard_negatives_in_many_regions_with_ties_and_odd_rows(spark, monkeypatch):
    for name, rows in (("BLOCK_ROWS", 150), ("LEAF_ROWS", 16), ("CHUNK_ROWS", 4)):
        monkeypatch.setattr(hard_negatives, name, rows)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 8)) * 2
    rows = [(i, (centres[i % 12] + rng.standard_normal(8) * 0.3).tolist(), i % 12 % 10) for i in range(3000)]
    rows[500:900] = [(i, centres[0].tolist(), i % 3) for i in range(500, 900)]  # a crowd of equal vectors
    rows += [(100, centres[1].tolist(), 3), (100, centres[1].tolist(), 3), (None, centres[0].tolist(), 1), (3000, None, 1), (3100, [None, 1.0], 1)]
    rows += [(3200, [float("nan")], 1), (3300, centres[0].tolist(), None), (3400, [1.0, 2.0], 2), (3500, [0.0] * 8, 2), (3600, [], 2), (3700, [float("-inf")] * 8, 2)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, region int, windows string")
    assert mined(frame) == all_scores(rows)
    assert mined(frame.limit(0)) == [] and mined(frame.limit(1)) == []


def test_huge_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [1.0, 1.9], 1), (2, [1.0, 1.8], 2)]
    frame = spark.createDataFrame([*rows, (3, [1e300, 1.0], 2)], "vec_id long, embedding array<double>, label int")
    assert mined(frame) == all_scores(rows) != []


# --- prefix trie ---


def told(conversations):
    return sorted((tuple(r) for r in prefix_trie.trie(conversations).collect()), key=repr)


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), r, x))
    nodes, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base, own = sorted(turns.get(c - int(math.fmod(c, 5)), [])), sorted(turns[c])
        path = tuple(t[3:] for t in [*base[:h], *own[h:]])
        ends[path].append(c)
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1].encode()) if n else 0
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], sha(n)) for n, m in list(nodes.items())), key=repr)


def test_trie_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    assert told(rows) == plain_trie([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_long_repeated_and_odd_conversations(spark):
    rows = [(0, i, "user", f"a{i % 3}") for i in range(300)] + [(3, i, "user", f"a{i % 3}") for i in range(270)] + [(3, 300, "x", "y")]
    rows += [(None, 1, "a", "b"), (7, None, None, None), (7, None, None, None), (7, 3, "u", None), (-3, 1, "q", "é"), (-3, 1, "q", "é"), (12, 0, "a", "b")]
    rows += [(c, 0, "u", "hello") for c in range(20, 700)]  # more ids at one node than a piece holds
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n_bytes int, node string")
    assert told(frame) == plain_trie(rows)
    assert told(frame.limit(0)) == []


def test_digests_of_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = [(c, i, "u", f"{i % 5}" if i < cut else f"{c}{i}") for c, cut in ((0, 70), (5, 64), (10, 16), (15, 33)) for i in range(70)]
    assert told(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == plain_trie(rows)


# --- token files ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, (1 << 32) - 1)), max_size=70))
def test_ranks_come_back(ranks):
    control, data = token_files.encode(np.array(ranks, np.uint32))
    assert token_files.decode(control, data, len(ranks)).tolist() == ranks


@pytest.mark.parametrize("least", [1, 3, 1000])
def test_blocks_come_back(least):
    import io

    documents = [(None, np.arange(7, dtype=np.uint32)), (3, np.zeros(0, np.uint32)), (3, np.array([9], np.uint32)), (5, np.arange(400, dtype=np.uint32))]
    got = []
    for doc_id, continues, ranks in token_files.unblocked(io.BytesIO(token_files.MAGIC + b"".join(token_files.blocks(iter(documents), least)))):
        if continues:
            got[-1][1].extend(ranks.tolist())
        else:
            got.append((doc_id, ranks.tolist()))
    assert got == [(d, r.tolist()) for d, r in documents]


def test_files_hold_the_tokenizers_ids(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(None, None), (-5, ""), (-5, ""), (-4, "hello world, a <|endoftext|> b"), (10**9, "word salad ünï 日本 " * 30000)]
    frame = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, counts int, ids binary").repartition(5)
    folder = f"file://{tmp_path}/tokens"
    token_files.write(frame, path, folder)
    got = token_files.read(spark, folder).collect()
    expected, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((doc_id, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == expected
    assert token_files.report(frame.limit(0), path).collect() == []


def test_what_a_lost_attempt_wrote_is_not_read_and_torn_files_are_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    token_files.write(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), queries.tokenizer_path(), folder)
    name = next(p for p in (tmp_path / "tokens").iterdir() if p.name.startswith("part-"))
    (tmp_path / "tokens" / "part-of-a-lost-attempt.tokens").write_bytes(name.read_bytes())
    assert [r.doc_id for r in token_files.read(spark, folder).collect()] == [1, 2]
    name.write_bytes(name.read_bytes()[:-1])
    with pytest.raises(Exception, match="ends inside a block"):
        token_files.read(spark, folder).collect()


# --- a caller's columns ---


def test_cutting_repeats_leaves_a_callers_columns_alone(spark):
    from loomgraph.llm import suffix_dedup

    shared = "".join(chr(97 + i * i % 26) for i in range(500))
    rows = [(1, f"first {shared} end", "h1", [1], "r1"), (2, f"second {shared}", "h2", [2], "r2"), (3, "short", "h3", None, None), (4, None, None, [], "r4")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _h string, _spans array<int>, _row string")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(frame).collect()}
    assert suffix_dedup.without_repeats(frame).columns == frame.columns
    assert {(i, r["_h"], r["_row"]) for i, r in got.items()} == {(i, h, x) for i, _, h, _, x in rows} and got[1]["_spans"] == [1]
    assert got[3].text == "short" and got[4].text is None and shared not in got[1].text and got[1].text.startswith("first") and got[2].text.startswith("second")
