"""The subpackage's queries over the standard tables and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import long_texts, table
from . import (
    hard_negatives, lm_scoring, minhash, mixing, neighbours, packing, pii, prefix_trie, quality_classifier, quality_rules, sharding, suffix_dedup, token_files,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_texts(spark)
    return table(spark, sf_dir, "documents")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_documents(spark, sf_dir))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir), tokenizer_path())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = quality_classifier.held_out()
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(~held))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality_classifier.PREDICT).cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    trusted = quality_rules.trusted_rows(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    judged = quality_rules.judge(docs.select("doc_id", "text"), trusted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_documents(spark, sf_dir))
    return planned.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 6).alias("position"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.layout(_documents(spark, sf_dir), 16)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = lm_scoring.score(docs, lm_scoring.in_training())
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = minhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", "class_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_texts(spark)
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.report(_documents(spark, sf_dir), tokenizer_path())


QUERIES = {
    "op1_pii": op1_pii,
    "op2_neighbours": op2_neighbours,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_packing": op4_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_files": op13_token_files,
}
#: crc32 of the texts by its table of 256, which eight halvings of each byte give.
CRC_SQL = """crct AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
    raw AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
    bytes AS (SELECT doc_id, n, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM raw),
    crc AS (SELECT doc_id, n + 1 AS size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, crct)"""

def _pii_sql() -> str:
    """Pieces between matches give the offsets, as in the operator; terms are runs that match the term pattern whole."""
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    term = r"[\p{L}\p{N}_]{3,}"
    found = " UNION ALL ".join(f"SELECT rid, {k} AS place, '{n}' AS kind, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g FROM docs" for k, (n, p) in enumerate(kinds.items()))
    begin = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    digit = "substr(d, length(d) - i + 1, 1)::INTEGER"
    return rf"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS th FROM documents),
        found AS ({found}),
        each AS (SELECT rid, place, kind, unnest(range(1, len(m) + 1)) AS i, m, g FROM found WHERE len(m) > 0),
        raw AS (SELECT rid, place, kind, m[i] AS value, ({begin})::BIGINT AS a, regexp_replace(m[i], '[^0-9]', '', 'g') AS d FROM each),
        spans AS (SELECT rid, place, kind, value, a AS low, a + length(value) AS high FROM raw WHERE CASE kind WHEN 'email' THEN true
            WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda x: NOT regexp_full_match(x, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})'))) = 0
            WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
            ELSE length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0 END),
        texts AS (SELECT th, min(rid) AS rid FROM docs GROUP BY 1),
        held AS (SELECT s.*, th, max(high) OVER (PARTITION BY s.rid ORDER BY low, place, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans s JOIN texts USING (rid)),
        gaps AS (SELECT rid, th, coalesce(before, 0) AS base, low AS stop FROM held WHERE low > coalesce(before, 0) UNION ALL SELECT h.rid, h.th, max(high), max(length(t)) FROM held h JOIN docs USING (rid) GROUP BY h.rid, h.th),
        pieces AS (SELECT g.th, base, substr(t, base + 1, stop - base) AS x FROM gaps g JOIN docs USING (rid)),
        runs AS (SELECT th, base, regexp_extract_all(x, '{term}') AS m, regexp_split_to_array(x, '{term}') AS g FROM pieces),
        each_term AS (SELECT th, base, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS term, unnest(g[1:len(m)]) AS gap FROM runs WHERE len(m) > 0),
        terms AS (SELECT th, term, (base + sum(length(gap) + length(term)) OVER (PARTITION BY th, base ORDER BY i))::BIGINT AS high FROM each_term),
        entities AS (SELECT DISTINCT th, kind || ':' || value AS entity, 2 AS least FROM held UNION SELECT DISTINCT th, kind, 5 FROM held),
        with_entity AS (SELECT entity, count(*) AS we FROM entities GROUP BY 1),
        pairs AS (SELECT entity, term, count(*) AS together FROM entities JOIN (SELECT DISTINCT th, term FROM terms) USING (th) GROUP BY ALL HAVING count(*) >= min(least)),
        seen AS (SELECT DISTINCT th, unnest(regexp_extract_all(t, '{term}')) AS term FROM docs),
        with_term AS (SELECT term, count(*) AS wt FROM seen WHERE term IN (SELECT term FROM pairs) GROUP BY 1),
        scored AS (SELECT entity, term, CASE WHEN ln(n / we) > 0 THEN ln(together * n / (we * wt)) / ln(n / we) ELSE 0 END AS share
            FROM pairs JOIN with_term USING (term) JOIN with_entity USING (entity), (SELECT greatest(count(DISTINCT th), 1)::DOUBLE AS n FROM docs)),
        marks AS (SELECT DISTINCT th, high - length(term) AS low, high FROM terms JOIN entities USING (th) JOIN scored USING (entity, term) WHERE share >= 0.8),
        whole AS (SELECT rid, low, place, high, kind FROM spans UNION ALL SELECT rid, low, 4, high, 'term' FROM marks JOIN docs USING (th)),
        joined AS (SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
            coalesce(string_agg(kind || ':' || low || ':' || high, ',' ORDER BY low, place, high) FILTER (place < 4), '') AS base, string_agg(kind || ':' || low || ':' || high, ',' ORDER BY low, place, high) AS spans FROM whole GROUP BY 1)
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN joined USING (rid)"""


ORACLE_SQL: dict[str, str] = {
    "op1_pii": _pii_sql(),
    "op3_suffix_dedup": """WITH raw AS (SELECT row_number() OVER () AS rid, doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT rid, h, unnest(range(n - 399)) AS i FROM raw WHERE n >= 400)),
        again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
        starts AS (SELECT rid, i, CASE WHEN i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 1 ELSE 0 END AS gap FROM w WHERE k IN (SELECT k FROM again)),
        spans AS (SELECT rid, min(i) AS low, max(i) + 400 AS high FROM (SELECT *, sum(gap) OVER (PARTITION BY rid ORDER BY i) AS island FROM starts) GROUP BY rid, island),
        cuts AS (SELECT s.rid, low, high, substr(h, 2 * coalesce(lag(high) OVER (PARTITION BY s.rid ORDER BY low), 0) + 1, 2 * (low - coalesce(lag(high) OVER (PARTITION BY s.rid ORDER BY low), 0))) AS kept FROM spans s JOIN raw USING (rid)),
        done AS (SELECT rid, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(kept, '' ORDER BY low) AS kept, max(high) AS last FROM cuts GROUP BY rid)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM raw LEFT JOIN done USING (rid)""",
    "op8_sharding": f"""WITH RECURSIVE {CRC_SQL},
        jump(id, k, j, shard, grown) AS (SELECT DISTINCT doc_id, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM documents
            UNION ALL SELECT id, k2, floor((j + 1) * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT, CASE WHEN j < 16 THEN j ELSE shard END, j
            FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM jump WHERE j <= 16))
        SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
            row_number() OVER (PARTITION BY shard ORDER BY ((coalesce(doc_id, 0) % 1024 + 1024) % 1024 + text_crc32) % 1024, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown::INTEGER AS grown_shard
        FROM crc JOIN jump ON doc_id IS NOT DISTINCT FROM id WHERE j > 16""",
    "op7_mixing": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ((coalesce(doc_id, 0) % 2147483648 + 2147483648) % 2147483648 * 2654435761 + 1) % 4294967296 AS f FROM documents),
        o AS (SELECT doc_id, source, size, (f // 65536 + f * 40503) % 2147483648 * 2246822519 % 4294967296 AS ord FROM d),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM o GROUP BY 1),
        p AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place, 3.0::DOUBLE * source_size AS cap FROM s),
        l AS (SELECT *, (place + 1)::DOUBLE AS weight FROM p),
        r AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS n
            FROM l WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, place, least(cap, coalesce((SELECT arg_min(level, n) FROM r WHERE cap >= level * weight) * weight, cap)) AS target FROM r),
        b AS (SELECT o.*, source_size, place, target, coalesce(sum(size) OVER (PARTITION BY o.source ORDER BY (ord + size) % 1024, ord, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
            CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 1 END AS rounds FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT *, target - rounds * source_size AS rest, (before + size / 2 < target - rounds * source_size) AND rounds < 3 AS extra FROM b),
        g AS (SELECT *, rest - sum(CASE WHEN extra THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM e),
        c AS (SELECT *, size > 0 AND rounds < 3 AND extra = (gap < 0) AND abs(abs(gap) - size) < abs(gap) AS fits FROM g),
        n AS (SELECT *, CASE WHEN fits THEN row_number() OVER (PARTITION BY source, fits ORDER BY abs(abs(gap) - size), ord, doc_id NULLS FIRST, size, before) = 1 ELSE false END AS swapped FROM c),
        k AS (SELECT *, CASE WHEN size = 0 THEN 1 ELSE rounds + (extra <> swapped)::BIGINT END AS copies, CASE WHEN target > 0 THEN least((before + size / 2) / target, 1.0) ELSE 0.0 END AS x, [-1.0, 0.0, 1.0][place + 1] AS slope, [1.5, 1.0, 0.5][place + 1] AS w FROM n),
        z AS (SELECT *, w * 0.5 + slope * 0.125 AS half FROM k)
        SELECT doc_id, size, source_size, target, copies * size AS taken, copies, round(CASE WHEN x <= half THEN 2 * x / (w + sqrt(greatest(w * w + 2 * slope * x, 0))) ELSE 0.5 + 2 * (x - half) / (1 + sqrt(greatest(1 + 2 * slope * (x - half), 0))) END, 6) AS position FROM z""",
    "op10_near_duplicates": r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT DISTINCT rid, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
        n AS (SELECT rid, count(*) AS n FROM g GROUP BY 1),
        p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE k * 1000 >= 800 * (x.n + y.n - k) UNION SELECT a.rid, b.rid FROM d a JOIN d b ON a.t = b.t AND a.rid < b.rid),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, u.b FROM r JOIN u ON u.a = r.other)
        SELECT doc_id, class_id FROM d JOIN (SELECT r.rid, min(x.doc_id) AS class_id FROM r JOIN d x ON x.rid = r.other GROUP BY 1) USING (rid)""",
    "op11_hard_negatives": """WITH fine AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, x.rid, x.vec_id, a.label = x.label AS same, list_sum(list_transform(range(1, least(len(a.c), len(x.c)) + 1), lambda i: a.c[i] * x.c[i]))::BIGINT AS score
            FROM fine a JOIN fine x ON a.rid <> x.rid WHERE a.vec_id % 100 = 0),
        positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) AS n FROM scored WHERE same) WHERE n <= 5),
        hard AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.arid, p.rid ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
            FROM positives p JOIN scored s ON s.arid = p.arid AND NOT s.same WHERE 80 * p.score <= 100 * s.score AND s.score <= p.score)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 5""",
    "op12_prefix_trie": f"""WITH {CRC_SQL.split("raw AS")[0].rstrip().rstrip(",")},
        num AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
        size AS (SELECT conv_id, count(*) AS n, conv_id::VARCHAR AS s FROM num GROUP BY 1),
        h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(s)), lambda i: ascii(substr(s, i + 1, 1))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 9 AS h FROM size, crct),
        c AS (SELECT h.*, least(h, coalesce(n, 0)) AS head FROM h LEFT JOIN size b ON b.conv_id = base),
        built AS (SELECT c.conv_id, pos AS i, r, x FROM c JOIN num n ON n.conv_id = base WHERE pos <= h UNION ALL SELECT c.conv_id, pos - h + head, r, x FROM c JOIN num n ON n.conv_id = c.conv_id WHERE pos > h),
        path AS (SELECT conv_id, i, octet_length(encode(x)) AS bytes, string_agg(md5(length(r) || ':' || r || x), '') OVER (PARTITION BY conv_id ORDER BY i) AS node, i = max(i) OVER (PARTITION BY conv_id) AS last FROM built
            UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM built) FROM c),
        nodes AS (SELECT node, min(conv_id) AS conv_id, max(i) AS depth, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM path GROUP BY 1),
        kids AS (SELECT left(node, 32 * (depth - 1)) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
        own AS (SELECT nodes.node, depth, (kids.n IS NULL)::INTEGER AS leaf, (n_convs - 1) * bytes AS saved FROM nodes LEFT JOIN kids USING (node)),
        sums AS (SELECT left(node, 32 * j) AS node, sum(leaf) AS n_leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS j FROM own) GROUP BY 1)
        SELECT a.conv_id, a.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(kids.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, a.ends_sha256
        FROM nodes a JOIN sums s USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes p ON a.depth > 0 AND p.node = left(a.node, 32 * (a.depth - 1))""",
}
