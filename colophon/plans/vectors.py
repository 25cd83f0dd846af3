"""Queries over embeddings and signatures. Every vector is a query and every vector is in the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from colophon.functions.cellref import a1_format
from colophon.functions.vectors import hamming, l2_normalize, match_level, median_signature, score_percent
from colophon.operators import similarity
from colophon.plans.inputs import Inputs, query
from colophon.sources.vectors import cache_key, read_vector_index, search_vector_index, write_vector_index
from colophon.session import checkpoint_dir

CELL_SQL = "CASE WHEN vec_id % 30 < 26 THEN chr(cast(65 + vec_id % 30 AS int)) ELSE 'A' || chr(cast(65 + vec_id % 30 - 26 AS int)) END || (vec_id // 30 + 1)"
UNIT = f"""
unit AS (
  SELECT vec_id, label, {CELL_SQL} AS cell, CASE WHEN norm < 1e-12 THEN e ELSE list_transform(e, lambda x: x / norm) END AS e FROM (
    SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))
)"""
DRAW = "('0x' || substr(md5('7|' || s || '|{}'), 1, 12))::BIGINT"
BASELINE = f"""
, idx AS (SELECT vec_id, e, row_number() OVER (ORDER BY substr(md5(vec_id::VARCHAR), 1, 3), vec_id) - 1 AS idx FROM unit
), drawn AS (
  SELECT i, (i + 1 + step) % n AS j FROM (SELECT {DRAW.format('i')} % n AS i, {DRAW.format('j')} % (n - 1) AS step, n
    FROM (SELECT unnest(range(1, 50001)) AS s) d, (SELECT count(*) AS n FROM unit) c)
), base AS (
  SELECT CASE WHEN (SELECT count(*) FROM unit) < 3 THEN 0.5 ELSE least(greatest(quantile_cont(cosine, 0.5), 0.0), 0.9) END AS baseline FROM (
    SELECT list_dot_product(a.e, b.e) AS cosine FROM drawn d JOIN idx a ON a.idx = d.i JOIN idx b ON b.idx = d.j
)
)"""


def _vectors(i: Inputs):
    e = i.table("embeddings")
    cell = a1_format(F.floor(F.col("vec_id") / 30), F.col("vec_id") % 30)
    return e.select(F.col("vec_id").alias("id"), cell.alias("cell"), "label", "embedding")


def _queries(df):
    return df.select(F.col("id").alias("query"), "embedding")


@query("l2_normalize", f"WITH {UNIT} SELECT vec_id, round(e[1], 6) AS first, round(list_sum(e), 6) AS total FROM unit")
def _(i):
    unit = i.table("embeddings").select("vec_id", l2_normalize(F.col("embedding")).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return unit.select("vec_id", F.round(F.col("e")[0], 6).alias("first"), F.round(total, 6).alias("total"))


@query("topk_inner_product", """
SELECT query, id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS query, v.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
  FROM embeddings q CROSS JOIN embeddings v) WHERE rank <= 5
""")
def _(i):
    v = _vectors(i)
    return similarity.topk_inner_product(_queries(v), v, 5).withColumn("score", F.round("score", 6))


@query("baseline_exact", f"""
WITH {UNIT} SELECT a.label, max(n) AS vectors, round(least(greatest(quantile_cont(list_dot_product(a.e, b.e), 0.5), 0.0), 0.9), 6) AS baseline
FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id < b.vec_id JOIN (SELECT label, count(*) AS n FROM unit GROUP BY ALL) c ON c.label = a.label GROUP BY a.label
""")
def _(i):
    unit = _vectors(i).withColumn("embedding", l2_normalize(F.col("embedding")))
    return similarity.baselines(unit, "label", method="exact").withColumn("baseline", F.round("baseline", 6))


@query("baseline_sampled", f"WITH {UNIT}{BASELINE} SELECT (SELECT count(*) FROM unit) AS vectors, round(baseline, 6) AS baseline FROM base")
def _(i):
    unit = _vectors(i).withColumn("embedding", l2_normalize(F.col("embedding"))).withColumn("catalogue", F.lit(1))
    return similarity.baseline_sampled(unit, "catalogue").select("vectors", F.round("baseline", 6).alias("baseline"))


RANKED = f"""
WITH {UNIT}{BASELINE}
, pairs AS (SELECT q.vec_id AS query, v.vec_id AS id, v.cell, list_dot_product(q.e, v.e) AS score FROM unit q CROSS JOIN unit v
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, cell) AS rank FROM pairs
), scored AS (SELECT r.*, 100 * least(greatest((score - baseline) / (1 - baseline), 0.0), 1.0) AS percent FROM ranked r, base WHERE rank <= 5)
"""


@query("rank_catalogue", RANKED + """
SELECT query, id, rank, round(score, 6) AS score, round(percent, 4) AS percent, CASE WHEN percent >= 70 THEN 'HIGH' WHEN percent >= 45 THEN 'MID' ELSE 'LOW' END AS level FROM scored
""")
def _(i):
    v = _vectors(i)
    ranked = similarity.rank_catalogue(_queries(v), v, 5)
    return ranked.select(
        "query", "id", "rank", F.round("score", 6).alias("score"), F.round("percent", 4).alias("percent"), "level"
    )


@query("score_percent", """
SELECT o_orderkey, round(100 * least(greatest((c - b) / (1 - b), 0.0), 1.0), 3) AS percent,
  CASE WHEN 100 * least(greatest((c - b) / (1 - b), 0.0), 1.0) >= 70 THEN 'HIGH' WHEN 100 * least(greatest((c - b) / (1 - b), 0.0), 1.0) >= 45 THEN 'MID' ELSE 'LOW' END AS level
FROM (SELECT o_orderkey, o_totalprice / 500000 AS c, least(greatest((o_custkey % 120) / 100.0 - 0.1, 0.0), 0.95) AS b FROM orders)
""")
def _(i):
    base = F.col("o_custkey") % 120 / 100.0 - 0.1
    percent = score_percent(F.col("o_totalprice") / 500000, base)
    return i.table("orders").select("o_orderkey", F.round(percent, 3).alias("percent"), match_level(percent).alias("level"))


SIGNATURES = """
sig AS (
  SELECT vec_id, CASE WHEN s >= 9223372036854775808 THEN (s - 18446744073709551616)::BIGINT ELSE s::BIGINT END AS signature FROM (
    SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN e[i] > m THEN (1::HUGEINT << (i - 1)) ELSE 0::HUGEINT END))::HUGEINT AS s
    FROM (SELECT vec_id, embedding AS e, list_sort(embedding[2:64])[32] AS m FROM embeddings))
)"""


def _signatures(i):
    return _vectors(i).select("id", "cell", median_signature(F.col("embedding")).alias("signature"))


@query("median_signature", f"WITH {SIGNATURES} SELECT vec_id, signature FROM sig")
def _(i):
    return _signatures(i).select(F.col("id").alias("vec_id"), "signature")


# Each signature with a re-scan that differs in up to two bits and an exact copy.
SCANS = """
, scans AS (
  SELECT vec_id AS id, signature FROM sig UNION ALL SELECT vec_id + 2000000, signature FROM sig
  UNION ALL SELECT vec_id + 1000000, xor(xor(signature, 1::BIGINT << (vec_id % 61)), 1::BIGINT << ((vec_id * 7 + 3) % 61)) FROM sig
)"""


def _scans(i):
    s = _signatures(i).select("id", "signature")
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    near = F.col("signature").bitwiseXOR(bit(F.col("id") % 61)).bitwiseXOR(bit((F.col("id") * 7 + 3) % 61))
    return (
        s.unionByName(s.withColumn("id", F.col("id") + 2_000_000))
        .unionByName(s.select((F.col("id") + 1_000_000).alias("id"), near.alias("signature")))
    )


@query("hamming_pairs", f"""
WITH {SIGNATURES}{SCANS}, g AS (SELECT signature, count(*) AS copies, min(id) AS first_id FROM scans GROUP BY ALL)
SELECT a.signature AS signature_a, b.signature AS signature_b, a.copies AS copies_a, b.copies AS copies_b, a.first_id AS first_id_a, b.first_id AS first_id_b,
  bit_count(xor(a.signature, b.signature)) AS distance FROM g a JOIN g b ON a.signature < b.signature WHERE bit_count(xor(a.signature, b.signature)) <= 8
""")
def _(i):
    return similarity.hamming_pairs(_scans(i))


@query("signature_groups", f"WITH {SIGNATURES}{SCANS} SELECT signature, count(*) AS copies, min(id) AS first_id FROM scans GROUP BY ALL")
def _(i):
    return similarity.signature_groups(_scans(i))


@query("rank_by_hamming", f"""
WITH {SIGNATURES}, cells AS (SELECT vec_id, {CELL_SQL} AS cell FROM embeddings)
SELECT query, id, rank, distance, 1 - distance / 32 AS score FROM (
  SELECT q.vec_id AS query, v.vec_id AS id, bit_count(xor(q.signature, v.signature)) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.signature, v.signature)), c.cell) AS rank
  FROM sig q CROSS JOIN sig v JOIN cells c ON c.vec_id = v.vec_id) WHERE rank <= 5
""")
def _(i):
    s = _signatures(i)
    return similarity.rank_by_hamming(s.select(F.col("id").alias("query"), "signature"), s, 5)


@query("frame_distance", f"""
WITH {SIGNATURES} SELECT a.vec_id, bit_count(xor(a.signature, b.signature)) AS distance FROM sig a JOIN sig b ON b.vec_id = a.vec_id + 1
""")
def _(i):
    s = _signatures(i)
    after = s.select((F.col("id") - 1).alias("id"), F.col("signature").alias("other"))
    return s.join(after, "id").select(F.col("id").alias("vec_id"), hamming(F.col("signature"), F.col("other")).alias("distance"))


NOISY = f"""
WITH {UNIT}, noisy AS (
  SELECT a.vec_id, list_transform(range(1, 65), lambda i: a.e[i] + 0.9 * coalesce(b.e[i], 0)) AS q FROM unit a LEFT JOIN unit b ON b.vec_id = a.vec_id * 7 + 1
), asked AS (SELECT vec_id, list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))) AS q FROM noisy
), pairs AS (SELECT a.vec_id AS query, v.vec_id AS id, v.cell, list_dot_product(a.q, v.e) AS score FROM asked a CROSS JOIN unit v
), truth AS (SELECT query, cell AS true_cell, score AS true_score FROM pairs WHERE query = id
), ranks AS (
  SELECT p.query, count(*) FILTER (p.id <> p.query AND (p.score > t.true_score + 1e-12 OR (abs(p.score - t.true_score) <= 1e-12 AND p.cell < t.true_cell))) + 1 AS rank,
    max(t.true_score) AS true_score, max(p.score) AS top_score FROM pairs p JOIN truth t USING (query) GROUP BY p.query
)"""


def _true_ranks(i):
    unit = _vectors(i).withColumn("embedding", l2_normalize(F.col("embedding")))
    other = unit.select(((F.col("id") - 1) / 7).alias("id"), F.col("embedding").alias("other"))
    mixed = F.zip_with("embedding", F.coalesce("other", F.transform("embedding", lambda x: F.lit(0.0))), lambda x, y: x + 0.9 * y)
    asked = unit.join(other, "id", "left").select(
        F.col("id").alias("query"), F.col("id").alias("true_id"), l2_normalize(mixed).alias("embedding")
    )
    return similarity.true_ranks(asked, unit)


@query("true_ranks", NOISY + " SELECT query, rank, round(true_score, 6) AS true_score, round(top_score, 6) AS top_score FROM ranks")
def _(i):
    return _true_ranks(i).select("query", "rank", F.round("true_score", 6).alias("true_score"), F.round("top_score", 6).alias("top_score"))


@query("evaluate_ranking", NOISY + """
, p AS (SELECT *, 100 * least(greatest((top_score - 0.5) / 0.5, 0.0), 1.0) AS percent FROM ranks)
SELECT 'vectors' AS ranker, count(*) AS queries, round(avg((rank = 1)::INT), 6) AS top1, round(avg((rank <= 5)::INT), 6) AS topk, round(avg(1.0 / rank), 6) AS mrr, round(quantile_cont(true_score, 0.05), 6) AS true_p5,
  round(quantile_cont(true_score, 0.5), 6) AS true_p50, round(coalesce(avg((percent >= 70)::INT) FILTER (rank = 1), 0), 6) AS high_correct, round(coalesce(avg((percent >= 70)::INT) FILTER (rank <> 1), 0), 6) AS high_wrong,
  round(coalesce(avg((percent >= 45)::INT) FILTER (rank = 1), 0), 6) AS mid_correct, round(coalesce(avg((percent >= 45)::INT) FILTER (rank <> 1), 0), 6) AS mid_wrong FROM p
""")
def _(i):
    scores = similarity.evaluate_ranking(_true_ranks(i).withColumn("ranker", F.lit("vectors")))
    return scores.select("ranker", "queries", *[F.round(c, 6).alias(c) for c in scores.columns if c not in ("ranker", "queries")])


@query("vector_cache_key", """
SELECT vec_id, sha256('v1|' || label || '|A1:Z99|model-' || vec_id % 3 || '|floating=' || (vec_id % 2 = 0)::VARCHAR) AS cache_key FROM embeddings
""")
def _(i):
    return i.table("embeddings").select("vec_id", cache_key(
        F.col("label").cast("string"), F.lit("A1:Z99"), F.concat(F.lit("model-"), (F.col("vec_id") % 3).cast("string")), F.col("vec_id") % 2 == 0
    ).alias("cache_key"))


@query("vector_index", f"""
WITH {UNIT} SELECT label, count(*) AS vectors, round(sum(list_sum(e)), 4) AS total FROM unit WHERE label IN (SELECT label FROM (SELECT DISTINCT label FROM unit) ORDER BY sha256('v1|' || label || '|A1:Z99|m|floating=true') LIMIT 8) GROUP BY ALL
""")
def _(i):
    """Every label's index, written twice: the second writing replaces the first."""
    key = cache_key(F.col("label").cast("string"), F.lit("A1:Z99"), F.lit("m"), F.lit(True))
    unit = _vectors(i).withColumn("cache_key", key).withColumn("embedding", l2_normalize(F.col("embedding")))
    path = f"{checkpoint_dir(i.spark)}/index-{i.spark.range(1).select(F.uuid()).first()[0]}"
    write_vector_index(unit, path, at=1)
    write_vector_index(unit, path, at=1)
    labels = unit.select("id", "label")
    rows = read_vector_index(i.spark, path).join(labels, "id")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("label").agg(F.count("*").alias("vectors"), F.round(F.sum(total), 4).alias("total"))


@query("search_vector_index", f"""
WITH {UNIT} SELECT query, id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS query, v.vec_id AS id, list_dot_product(q.e, v.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, v.e) DESC, v.vec_id) AS rank
  FROM unit q CROSS JOIN unit v WHERE q.vec_id % 50 = 0) WHERE rank <= 5
""")
def _(i):
    """Every vector is indexed; queries are those whose id is divisible by 50."""
    unit = _vectors(i).withColumns({"cache_key": F.lit("all"), "embedding": l2_normalize(F.col("embedding"))})
    path = f"{checkpoint_dir(i.spark)}/index-{i.spark.range(1).select(F.uuid()).first()[0]}"
    write_vector_index(unit, path, at=1)
    found = search_vector_index(i.spark, path, "all", _queries(unit.filter("id % 50 = 0")), 5)
    return found.withColumn("score", F.round("score", 6))
