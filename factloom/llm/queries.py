"""The queries of this folder's operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bitslice, exact_dedup, jaccard, language_model, licences, lloyd, merkle, mixing, packing, pseudonyms, substrings, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"))


def op5_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from the session; the fallback is no secret and serves these invented tables only."""
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), spark.conf.get("spark.factloom.pseudonymKey", "invented tables"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.judged(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.dedup(docs, exact_dedup.earlier_half(docs)).drop("row")


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clustered(table(spark, sf_dir, "embeddings"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.verified(docs, merkle.newlines_deleted(docs))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, len(embedding) AS dims, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND a.dims = b.dims
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), g AS (
  SELECT doc_id AS g_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), k AS (
  SELECT d.*, -ln((CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
    / CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.8 END AS key
  FROM d LEFT JOIN g ON doc_id = g_id
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(source_size) OVER () AS total FROM s
), f AS (
  SELECT *, 3 * total - 2 * 2 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source IS NULL, source)
), level AS (
  SELECT rest, open FROM f WHERE rest * weight < source_size * 4 * open ORDER BY CAST(source_size AS DOUBLE) / weight, source IS NULL, source LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN rest * weight >= source_size * 4 * open OR NOT EXISTS (SELECT 1 FROM level) THEN CAST(2 * source_size AS DOUBLE)
    ELSE CAST((SELECT rest FROM level) * weight AS DOUBLE) / CAST((SELECT open FROM level) * 2 AS DOUBLE) END AS target
  FROM f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), b AS (
  SELECT k.doc_id, k.size, k.key, e.*, CAST(floor(target - epochs * source_size + 0.5) AS BIGINT) AS budget,
    sum(size) OVER (PARTITION BY e.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY e.source ORDER BY key, doc_id, size) AS turn
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
), c AS (
  SELECT *, min(CASE WHEN upto > budget THEN turn END) OVER (PARTITION BY source) AS stop FROM b
), h AS (
  SELECT *, budget - coalesce(max(CASE WHEN turn < stop THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM c
), x AS (
  SELECT source AS x_source, arg_min(turn, (abs(size - gap), turn)) AS fill FROM h WHERE stop IS NOT NULL AND turn >= stop AND size > 0 AND abs(size - gap) < gap GROUP BY source
)
SELECT doc_id, size, source_size, target,
  CAST((epochs + CASE WHEN turn < stop OR (stop IS NULL AND budget > 0) OR turn = fill THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM h LEFT JOIN x ON source IS NOT DISTINCT FROM x_source
"""

OP10_SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


_SQUARE = "CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
_ROUND = f"""
a{{0}} AS MATERIALIZED (
  SELECT v.row, min({_SQUARE} * 64 + c.cluster) AS best FROM v, c{{0}} c GROUP BY v.row
), p{{0}} AS (
  SELECT best % 64 AS cluster, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM a{{0}} JOIN v USING (row)
), s{{0}} AS (
  SELECT cluster, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM p{{0}} GROUP BY ALL
), m{{0}} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS q FROM s{{0}} GROUP BY cluster
), c{{1}} AS MATERIALIZED (
  SELECT cluster, coalesce(m.q, c.q) AS q FROM c{{0}} c LEFT JOIN m{{0}} m USING (cluster)
)"""
OP11_SQL = f"""
WITH k AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT row, vec_id, e, list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS q FROM k
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, e) - 1 AS cluster, q FROM v QUALIFY cluster < 40
), {", ".join(_ROUND.format(i, i + 1) for i in range(5))},
f AS (
  SELECT v.row, v.vec_id, min({_SQUARE} * 64 + c.cluster) AS best FROM v, c5 c GROUP BY ALL
), g AS (
  SELECT vec_id, CAST(best % 64 AS INTEGER) AS cluster, best // 64 AS distance FROM f
)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256
FROM g JOIN c5 USING (cluster)
"""

MERKLE_LEVELS = 14  # the SQL's trees have up to 3^14 leaves


def _merkle_tree(name: str, base: str) -> str:
    """CTEs over base (g, i, n, h): the levels of its trees, their runs, and of each leaf the siblings and the root of its tree."""
    out = [f"{name}0 AS (SELECT g, i, n, h FROM {base})"]
    for k in range(MERKLE_LEVELS):
        out.append(f"{name}r{k} AS (SELECT g, i // 3 AS p, list(h ORDER BY i) AS hs FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS (SELECT g, i // 3 AS i, (n + 2) // 3 AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY g, i // 3, n)")
    return ", ".join(out)


def _merkle_walk(name: str, tree: str, start: str) -> str:
    """CTEs from start (row, g, i, proof, f): level by level the siblings are appended to proof, and f is folded."""
    out = [f"{name}0 AS ({start})"]
    for k in range(MERKLE_LEVELS):
        at = f"(i // {3**k}) % 3"
        left, right = f"array_to_string(hs[1:{at}], '')", f"array_to_string(hs[{at} + 2:], '')"
        out.append(f"""{name}{k + 1} AS (SELECT row, w.g, i, CASE WHEN hs IS NULL THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN hs IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f
          FROM {name}{k} w LEFT JOIN {tree}r{k} r ON w.g = r.g AND i // {3 ** (k + 1)} = p)""")
    return ", ".join(out)


_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_CRC_EVEN = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) % 2 = 1"""
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)")) + " || " + _FIELD + ")"
OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, doc_id, {_LEAF.format("text")} AS h,
    {_LEAF.format("CASE WHEN " + _CRC_EVEN + " THEN replace(text, chr(10), '') ELSE text END")} AS altered FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d
), {_merkle_tree("t", "l")}, s AS (
  SELECT 0 AS g, g AS i, count(*) OVER () AS n, h FROM t{MERKLE_LEVELS}
), {_merkle_tree("u", "s")}, {_merkle_walk("a", "t", "SELECT row, g, i, '' AS proof, altered AS f FROM l")},
{_merkle_walk("b", "u", f"SELECT row, 0 AS g, g AS i, proof, f FROM a{MERKLE_LEVELS}")}
SELECT doc_id, l.h AS leaf, t.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = u.h AS verified
FROM l JOIN b{MERKLE_LEVELS} b USING (row) JOIN t{MERKLE_LEVELS} t ON l.g = t.g, u{MERKLE_LEVELS} u
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_substring_dedup, op3_packing, op4_token_counts, op5_bit_sliced_top_k, op6_parity_jaccard, op7_mixing, op8_feistel_pseudonyms, op9_language_model, op10_exact_dedup, op11_dual_tree_lloyd, op12_license_scans, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op5_bit_sliced_top_k": OP5_SQL, "op7_mixing": OP7_SQL, "op10_exact_dedup": OP10_SQL, "op11_dual_tree_lloyd": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
