"""Queries of embedding operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.catalog.registry import Inputs, query, rounded
from freshet.operators import vectors



@query("l2_normalise", """
WITH n AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings),
s AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS norm FROM n GROUP BY vec_id)
SELECT vec_id, CAST(i - 1 AS INT) AS i, round(CAST(x AS DOUBLE) / norm, 6) AS x FROM n JOIN s USING (vec_id)""")
def l2_normalise(d: Inputs) -> DataFrame:
    out = vectors.l2_normalise(d.table("embeddings"))
    return out.select("vec_id", F.posexplode("unit").alias("i", "x")).select("vec_id", "i", *rounded("x"))


@query("cosine_neighbours", """
WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM n),
p AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 9) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour) AS rank FROM p)
SELECT vec_id, rank, neighbour, round(s, 3) AS sim FROM r WHERE rank <= 5""")
def cosine_neighbours(d: Inputs) -> DataFrame:
    return vectors.cosine_neighbours(d.table("embeddings"), 5, "vec_id")


CLUSTERS, ROUNDS = 5, 10
_APART = "list_sum(list_transform(list_zip(p.x, {}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _clusters_sql() -> str:
    """The same start and the same rounds, one after the other."""
    steps = ["""p AS (SELECT vec_id, list_transform(v, lambda e: CAST(floor(e / norm * 1000000 + 0.5) AS BIGINT)) AS x FROM (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)))""",
             "c0 AS (SELECT [x] AS c FROM p ORDER BY vec_id LIMIT 1)"]
    for i in range(1, CLUSTERS):
        steps.append(f"c{i} AS (SELECT list_append(c, x) AS c FROM p, c{i - 1} ORDER BY list_min(list_transform(c, lambda y: {_APART.format('y')})) DESC, vec_id LIMIT 1)")
    before = f"c{CLUSTERS - 1}"
    for i in range(ROUNDS):
        steps.append(f"""a{i} AS (SELECT vec_id, x, list_position(d, list_min(d)) AS cluster FROM (
  SELECT vec_id, x, list_transform(c, lambda y: {_APART.format('y')}) AS d FROM p, {before})),
s{i} AS (SELECT cluster, place, 2 * sum(v) + count(*) AS a, 2 * count(*) AS b FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM a{i}) GROUP BY 1, 2),
o{i} AS (SELECT unnest(c) AS was, generate_subscripts(c, 1) AS cluster FROM {before}),
m{i} AS (SELECT list(coalesce(now, was) ORDER BY cluster) AS c FROM o{i} LEFT JOIN (
  SELECT cluster, list(CAST((a - (a % b + b) % b) // b AS BIGINT) ORDER BY place) AS now FROM s{i} GROUP BY 1) USING (cluster))""")
        before = f"m{i}"
    return ("WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(list_position(d, list_min(d)) - 1 AS INT) AS cluster FROM (SELECT vec_id, list_transform(c, lambda y: {_APART.format('y')}) AS d FROM p, {before})""")


@query("kmeans_clusters", _clusters_sql())
def kmeans_clusters(d: Inputs) -> DataFrame:
    return vectors.kmeans_clusters(d.table("embeddings"), CLUSTERS, ROUNDS).select("vec_id", "cluster")


@query("static_vectors", """
SELECT lpad(CAST(p_partkey + 10000000 AS STRING), 8, '0') AS "STAID", CAST(p_size AS FLOAT) AS a, CAST(p_retailprice AS FLOAT) AS b, 'p_size,p_retailprice' AS names FROM part""")
def static_vectors(d: Inputs) -> DataFrame:
    p = d.table("part").select(F.lpad((F.col("p_partkey") + 10000000).cast("string"), 8, "0").alias("STAID"), "p_brand", "p_size", "p_retailprice")
    out = vectors.static_vectors(p)
    return out.select("STAID", F.get("static", F.lit(0)).alias("a"), F.get("static", F.lit(1)).alias("b"), F.array_join("static_names", ",").alias("names"))
