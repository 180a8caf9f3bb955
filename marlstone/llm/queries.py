"""The registered queries of the operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import alignment, bpe, decontamination, mixing, near_dedup, neighbours, quality, resampling, secrets, sharding, substring_dedup, toxicity, warc
from marlstone.llm.fitting import remainder
from marlstone.llm.runtime import table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: The tokenizers that op12 aligns.
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.written(base).cast("binary"), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CAST(coalesce(octet_length(text), 0) + 16 AS bigint) AS size", "crc32(CAST(coalesce(text, '') AS binary)) AS text_crc32"
    )
    placed = sharding.assign(docs, key="doc_id", ties=["size", "text_crc32"], shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, epochs=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ALIGNED)
    return alignment.align(table(spark, sf_dir, "documents"), a, b, public_tokenizers.PATTERN)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least=20, highest=1, buckets=10_000, seed="2024")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}


# Texts with A to Z made small, and the words of a benchmark item or a document, as DuckDB reads them.
_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_REF = warc.REFERENCE.replace("\\", "\\\\")
_NAMES = "MAP {" + ", ".join(f"'{name}': " + (f"chr({ord(char)})") for name, char in warc.ENTITIES.items()) + "}"
ORACLES = {
    "op1_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS seq FROM s),
firsts AS (SELECT seq, min(doc_id) AS least FROM wins GROUP BY seq),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM wins JOIN firsts USING (seq) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS kept FROM words w ANTI JOIN hit h ON w.doc_id = h.doc_id AND w.p = h.p GROUP BY w.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id
""",
    "op4_minhash_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_SMALL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS p, b.doc_id AS q FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT p, q FROM links UNION SELECT r.p, l.q FROM reach r JOIN links l ON r.q = l.p),
least AS (SELECT p, min(q) AS q FROM reach GROUP BY p)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(coalesce(q, doc_id), doc_id) AS component_id, least(coalesce(q, doc_id), doc_id) = doc_id AS kept
FROM sets LEFT JOIN least ON p = doc_id
""",
    "op7_warc_derivatives": f"""
WITH s AS (SELECT page_id, CAST(url AS VARCHAR) AS target_uri, coalesce(html, '') AS body FROM pages),
p AS (SELECT *, 'sha1:' || sha1(body) AS payload, md5(concat_ws(chr(10), 'response', CAST(page_id AS VARCHAR), target_uri, 'sha1:' || sha1(body))) AS h FROM s),
r AS (SELECT *, '<urn:uuid:' || concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) || '>' AS refers_to FROM p),
texts AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(body, '<(script|style)\\b.*?</(script|style)\\s*>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '[ \\t\\r\\n]+', ' ', 'g')) AS plain FROM r),
refs AS (SELECT *, regexp_split_to_array(plain, '{_REF}') AS pieces, regexp_extract_all(plain, '{_REF}', 1) AS names FROM texts),
codes AS (SELECT *, list_transform(names, lambda n: CASE WHEN n LIKE '#x%' OR n LIKE '#X%' THEN CAST(concat('0x', n[3:]) AS BIGINT) WHEN n LIKE '#%' THEN CAST(n[2:] AS BIGINT) END) AS numbers FROM refs),
chars AS (SELECT *, list_transform(list_zip(names, numbers), lambda x: CASE WHEN x[2] = 160 THEN ' ' WHEN x[2] BETWEEN 1 AND 1114111 AND x[2] NOT BETWEEN 55296 AND 57343 THEN chr(CAST(x[2] AS INTEGER))
WHEN x[2] IS NOT NULL THEN chr(65533) ELSE coalesce({_NAMES}[x[1]], concat('&', x[1], ';')) END) AS made FROM codes),
plains AS (SELECT *, array_to_string(list_transform(list_zip(pieces, made), lambda x: concat(x[1], coalesce(x[2], ''))), '') AS solved FROM chars),
c AS (SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS mime, 'content-length: ' || strlen(body) || chr(13) || chr(10) || 'payload-digest: ' || payload || chr(13) || chr(10) AS content FROM plains
UNION ALL SELECT *, 'conversion', 'text/plain', trim(regexp_replace(solved, '[ \\t\\r\\n]+', ' ', 'g')) FROM plains),
b AS (SELECT *, 'sha1:' || sha1(content) AS block_digest FROM c),
i AS (SELECT *, md5(concat_ws(chr(10), warc_type, refers_to, block_digest)) AS g FROM b),
n AS (SELECT *, '<urn:uuid:' || concat_ws('-', g[1:8], g[9:12], g[13:16], g[17:20], g[21:32]) || '>' AS record_id FROM i)
SELECT page_id, warc_type, record_id, refers_to, target_uri, payload, block_digest, concat_ws(chr(13) || chr(10), 'WARC/1.0', 'WARC-Type: ' || warc_type, 'WARC-Record-ID: ' || record_id,
'WARC-Date: 1970-01-01T00:00:00Z', 'WARC-Refers-To: ' || refers_to, 'WARC-Target-URI: ' || regexp_replace(target_uri, '[\\x00-\\x1F\\x7F]+', '', 'g'), 'WARC-Block-Digest: ' || block_digest,
'WARC-Payload-Digest: ' || payload, 'Content-Type: ' || mime, 'Content-Length: ' || strlen(content), '', '') AS header, content FROM n
""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_SMALL}, '{_WORD}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_SMALL}, '{_WORD}') AS w FROM benchmark),
wins AS (SELECT item_id, least(len(w), 13) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS seq FROM items WHERE len(w) > 0),
starts AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM wins)),
found AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS seq FROM starts) JOIN wins USING (k, seq)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY 1),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS x FROM found GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items, sha256(coalesce(x, '')) AS items_sha256,
coalesce(hits.n > 0 AND 20 * hits.n >= len(w), FALSE) AS contaminated FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id
""",
}


# Secrets as SQL: matches of each kind from the pieces between them, then pairs of matches of a document.
_CLASS = "[A-Za-z0-9+/_=-]"
#: RE2 has no look-around: a run of the class is longest as it is, and that it holds a digit and a letter is asked afterwards.
_PLAIN = {k.name: (f"{_CLASS}{{20,}}" if k.name == "blob" else k.pattern.replace("\\x20", " ")) for k in secrets.KINDS}


def _matches(at: int, kind: secrets.Kind) -> str:
    pattern = _PLAIN[kind.name].replace("'", "''")
    also = " AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')" if kind.name == "blob" else ""
    return f"""
SELECT doc_id, {at} AS kind, z - length(match) AS a, z FROM (
  SELECT doc_id, match, value, sum(length(piece) + length(match)) OVER (PARTITION BY doc_id ORDER BY n) AS z FROM (
    SELECT doc_id, unnest(pieces[1:len(matches)]) AS piece, unnest(matches) AS match, unnest(found) AS value, unnest(range(len(matches))) AS n FROM (
      SELECT doc_id, string_split_regex(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}') AS matches, regexp_extract_all(text, '{pattern}', {kind.group}) AS found FROM d)))
WHERE length(value) >= {kind.least}{also}"""


_COMPLETES = " OR ".join(f"(w.kind = {i} AND o.kind IN ({', '.join(str(j) for j, x in enumerate(secrets.KINDS) if x.name in k.completed_by)}))" for i, k in enumerate(secrets.KINDS) if k.completed_by)
_BASE_KINDS = ", ".join(map(str, secrets.BASE))
_SHOWN = "CASE kind " + " ".join(f"WHEN {i} THEN '{k.name}'" for i, k in enumerate(secrets.KINDS)) + " END || ':' || CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT)"
ORACLES["op2_secret_linking"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS MATERIALIZED ({" UNION ALL ".join(_matches(i, k) for i, k in enumerate(secrets.KINDS))}),
spans AS (SELECT * FROM parts WHERE kind IN ({_BASE_KINDS})
UNION ALL SELECT * FROM parts w WHERE EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = w.doc_id AND greatest(w.a - o.z, o.a - w.z) BETWEEN 0 AND {secrets.SCOPE} AND ({_COMPLETES}))
AND NOT EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = w.doc_id AND o.kind IN ({_BASE_KINDS}) AND greatest(w.a - o.z, o.a - w.z) < 0)),
shown AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
string_agg(CASE WHEN kind IN ({_BASE_KINDS}) THEN {_SHOWN} END, ',' ORDER BY a, kind, z) AS base, string_agg({_SHOWN}, ',' ORDER BY a, kind, z) AS every FROM spans GROUP BY 1)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN shown USING (doc_id)
"""


_DOT = "list_reduce(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]), lambda s, x: s + x)"
ORACLES["op10_nearest_vectors"] = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
v AS (SELECT vec_id, x, sqrt({_DOT.format("x", "x")}) AS norm FROM e WHERE len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, {_DOT.format("q.x", "c.x")} / (q.norm * c.norm) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


ORACLES["op11_mixing"] = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][place % 3 + 1] AS weight, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
l AS (SELECT coalesce(min_by((budget - before) / free, cap / weight) FILTER (weight * ((budget - before) / free) <= cap), 1e300) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN weight * level > cap THEN cap ELSE weight * level END AS target FROM w, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, source_size, target, whole, CAST(floor(target) AS BIGINT) - whole * source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS upto
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(whole * size + least(size, greatest(0, rest - (upto - size))) AS BIGINT) AS taken FROM r
"""
_BUCKET = "(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) % 10000"
ORACLES["op13_importance_resampling"] = f"""
WITH RECURSIVE bits AS (SELECT range AS b, range AS c, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY b) AS steps FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all({_SMALL}, '{_WORD}') AS w FROM documents),
x AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY 1),
y AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_SMALL}, '{_WORD}')) AS word FROM benchmark) GROUP BY 1),
words AS (SELECT word, list_transform(range(1, length(hex(word)) // 2 + 1), lambda i: CAST('0x' || substr(hex(word), 2 * i - 1, 2) AS BIGINT)) AS bytes FROM (SELECT word FROM x UNION SELECT word FROM y)),
bucket AS MATERIALIZED (SELECT word, {_BUCKET} AS k FROM words, steps),
s AS (SELECT k, sum(n) AS n FROM x JOIN bucket USING (word) GROUP BY 1), t AS (SELECT k, sum(n) AS n FROM y JOIN bucket USING (word) GROUP BY 1),
total AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t),
gain AS (SELECT range AS k, CAST(floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (total.s + 10000) / ((coalesce(s.n, 0)::DOUBLE + 1) * (total.t + 10000)))) AS BIGINT) AS gain
FROM range(10000) LEFT JOIN s ON s.k = range LEFT JOIN t ON t.k = range, total),
of AS (SELECT doc_id, len(w) AS n, w, row_number() OVER () AS i FROM d),
sums AS (SELECT i, sum(gain) AS gains FROM (SELECT i, unnest(w) AS word FROM of) JOIN bucket USING (word) JOIN gain USING (k) GROUP BY 1),
scored AS (SELECT doc_id, n, CAST(CASE WHEN n > 0 THEN floor(gains / n) ELSE 0 END AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM of LEFT JOIN sums USING (i)),
noisy AS (SELECT doc_id, n, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS LAST, n) AS place, (SELECT count(*) FROM noisy WHERE n >= 20) * 10 // 100 AS drawn FROM noisy)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN n >= 20 AND place <= drawn THEN place END AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
