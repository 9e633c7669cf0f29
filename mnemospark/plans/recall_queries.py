"""Queries over vectors and ranks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators import recall
from mnemospark.operators.scan import scan
from mnemospark.sources.memory_tables import NODES_SQL, nodes, table


def _query(n: DataFrame) -> DataFrame:
    return n.where("node_id = 0").select(F.col("v").alias("q"))


_SCORED = f"""WITH {NODES_SQL}, scored AS (
  SELECT n.*, list_cosine_similarity(n.v, (SELECT v FROM nodes WHERE node_id = 0)) AS score FROM nodes n)"""


def vec_topk(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return recall.knn(n, _query(n), 10).select("node_id", F.round("score", 6).alias("score"))


def vec_floor_scan(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return recall.floor_scan(n, _query(n), 0.2).select("node_id", F.round("score", 6).alias("score"))


def vec_topk_per_label(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return recall.topk_per_label(n, _query(n), 3, 12).select("node_id", "label", "label_rank", F.round("score", 6).alias("score"))


def _queries(n: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 50 is a query."""
    return n.where("node_id % 50 = 0").select(F.col("node_id").alias("query_id"), F.col("v").alias("q"))


def vec_topk_all(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return recall.knn_all(n, _queries(n), 10).select("query_id", "node_id", F.round("score", 6).alias("score"))


def vec_floor_scan_all(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return recall.floor_scan_all(n, _queries(n), 0.2).select("query_id", "node_id", F.round("score", 6).alias("score"))


def vec_topk_per_label_all(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return recall.topk_per_label_all(n, _queries(n), 3, 12).select("query_id", "node_id", "label", "label_rank", F.round("score", 6).alias("score"))


def vec_centroids(spark, sf_dir):
    c = recall.centroids(nodes(spark, sf_dir))
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def vec_classify(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return recall.classify(n, recall.centroids(n), 0.30, 0.18)


def _ranked(n: DataFrame) -> DataFrame:
    """Two sources: nearest vectors, and live nodes of the query's label by strength."""
    near = recall.knn(n, _query(n), 30).select("node_id", "score")
    a = near.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node_id")) - 1).select(F.lit("vector").alias("source"), "node_id", "rank")
    same = n.join(F.broadcast(n.where("node_id = 0").select(F.col("label").alias("want"))), F.col("label") == F.col("want")).where("NOT archived")
    top = same.orderBy(F.desc("strength"), "node_id").limit(30)
    b = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("strength"), "node_id")) - 1).select(F.lit("strength").alias("source"), "node_id", "rank")
    return a.unionByName(b)


_FUSED = _SCORED + """, ranked AS (
  SELECT * FROM (SELECT 'vector' AS source, node_id, row_number() OVER (ORDER BY score DESC, node_id) - 1 AS rank FROM scored WHERE NOT archived) WHERE rank < 30
  UNION ALL
  SELECT * FROM (SELECT 'lexical', node_id, row_number() OVER (ORDER BY strength DESC, node_id) - 1 AS rank FROM nodes
                 WHERE NOT archived AND label = (SELECT label FROM nodes WHERE node_id = 0)) WHERE rank < 30
), fused AS (SELECT node_id, sum(1.0 / (60 + rank + 1)) AS rrf, count(*) AS sources FROM ranked GROUP BY node_id)"""


def rrf_fusion(spark, sf_dir):
    return recall.rrf(_ranked(nodes(spark, sf_dir))).select("node_id", F.round("rrf", 6).alias("rrf"), "sources")


def _valence(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    return l.groupBy(F.col("doc_id").alias("node_id")).agg(F.avg(F.col("quality") - F.col("toxic")).alias("avg_valence"))


_ADJUSTED = _FUSED + """, valence AS (SELECT doc_id AS node_id, avg(quality - toxic) AS avg_valence FROM labels GROUP BY doc_id
), adjusted AS (
  SELECT f.*, n.strength, n.confidence, rrf * (1 + least(5.0, greatest(0.0, coalesce(strength, 0.0))) / 10)
         * (1 + 0.2 * least(1.0, greatest(-1.0, coalesce(avg_valence, 0.0)))) AS final
  FROM fused f LEFT JOIN nodes n USING (node_id) LEFT JOIN valence v USING (node_id))"""


def fusion_adjust(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return recall.fusion_adjust(recall.rrf(_ranked(n)), n, _valence(spark, sf_dir)).select("node_id", F.round("final", 6).alias("final"))


def recall_unified(spark, sf_dir):
    """Vector and strength sources (no text is read), fused, adjusted, loaded nodes demoted, top 10."""
    n = nodes(spark, sf_dir)
    final = recall.fusion_adjust(recall.rrf(_ranked(n)), n, _valence(spark, sf_dir))
    loaded = n.where("node_id % 3 = 0").select("node_id")
    shown = recall.demote_loaded(final, loaded).select("node_id", "is_loaded", F.round("rank_score", 6).alias("rank_score"))
    return shown.orderBy(F.desc("rank_score"), "node_id").limit(10)


def loaded_demotion(spark, sf_dir):
    """The same by strength and confidence, all rows."""
    n = nodes(spark, sf_dir)
    final = recall.fusion_adjust(recall.rrf(_ranked(n)), n, _valence(spark, sf_dir))
    return recall.demote_loaded(final, n.where("node_id % 3 = 0").select("node_id"), "rank").select("node_id", "is_loaded", F.round("rank_score", 6).alias("rank_score"))


def _neighbours(n: DataFrame) -> DataFrame:
    """A ring of neighbours by id: each node and the ids near half of it."""
    return n.select("node_id", F.explode(F.array(*[F.floor(F.col("node_id") / 4) + k for k in range(4)])).alias("neighbour"))


def jaccard_boost(spark, sf_dir):
    n = nodes(spark, sf_dir)
    candidates = recall.scored(n.where("NOT archived AND node_id <> 0"), _query(n)).select("node_id", F.round("score", 6).alias("score"))
    out = recall.boost_candidates(candidates, recall.jaccard(_neighbours(n)), 0, 0.0, 0.2, least=0.3)
    return out.select("node_id", "score", F.round("jaccard", 6).alias("jaccard"), F.round("boosted", 6).alias("boosted"))


def spreading_activation(spark, sf_dir):
    n = nodes(spark, sf_dir)
    seeds = recall.knn(n, _query(n), 10).select("node_id", (F.col("score") * 0.6).alias("activation"))
    links = _neighbours(n).select(F.col("node_id").alias("src"), F.col("neighbour").alias("dst"))
    out = recall.spread(seeds, links, above=0.1, least=0.01)
    return out.select("node_id", "is_seed", F.round("activation", 6).alias("activation"))


def similar_pairs_in_class(spark, sf_dir):
    """Pairs of one class over a floor (consistency-audit candidates): joined by class, never all with all."""
    n = nodes(spark, sf_dir).select("node_id", "label", "v")
    pairs = scan(n, n.select(F.col("node_id").alias("query_id"), "label", F.col("v").alias("q")), least=0.3 - 1e-6, within="label", ordered=True)
    return pairs.select(F.col("query_id").alias("a"), F.col("node_id").alias("b"), F.round("score", 6).alias("similarity")).where("similarity >= 0.3")


QUERIES = {f.__name__: f for f in (vec_topk, vec_floor_scan, vec_topk_per_label, vec_topk_all, vec_floor_scan_all, vec_topk_per_label_all, vec_centroids, vec_classify, rrf_fusion, fusion_adjust, recall_unified, loaded_demotion, jaccard_boost, spreading_activation, similar_pairs_in_class)}

_SCORED_ALL = f"""WITH {NODES_SQL}, scored AS (
  SELECT q.node_id AS query_id, n.*, list_cosine_similarity(n.v, q.v) AS s FROM nodes n, nodes q WHERE q.node_id % 50 = 0)"""
_CENTROIDS = f"""WITH {NODES_SQL}, e AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM nodes
), m AS (SELECT label, pos, avg(x) AS x FROM e GROUP BY label, pos), s AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label)"""
_RING = "ring AS (SELECT node_id, node_id // 4 + k AS neighbour FROM nodes, range(4) t(k))"

ORACLE_SQL = {
    "vec_topk": _SCORED + " SELECT node_id, round(score, 6) AS score FROM scored WHERE NOT archived ORDER BY scored.score DESC, node_id LIMIT 10",
    "vec_floor_scan": _SCORED + " SELECT node_id, round(score, 6) AS score FROM scored WHERE score > 0.2",
    "vec_topk_per_label": _SCORED + """ SELECT node_id, label, label_rank, round(s, 6) AS score FROM (
  SELECT node_id, label, score AS s, row_number() OVER (PARTITION BY label ORDER BY score DESC, node_id) AS label_rank FROM scored)
  WHERE label_rank <= 3 ORDER BY s DESC, node_id LIMIT 12""",
    "vec_topk_all": _SCORED_ALL + """ SELECT query_id, node_id, round(s, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS rank FROM scored WHERE NOT archived) WHERE rank <= 10""",
    "vec_floor_scan_all": _SCORED_ALL + " SELECT query_id, node_id, round(s, 6) AS score FROM scored WHERE s > 0.2",
    "vec_topk_per_label_all": _SCORED_ALL + """, l AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC, node_id) AS label_rank FROM scored
), m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS rank FROM l WHERE label_rank <= 3)
SELECT query_id, node_id, label, label_rank, round(s, 6) AS score FROM m WHERE rank <= 12""",
    "vec_centroids": _CENTROIDS + " SELECT label, CAST(pos AS INTEGER) AS pos, round(x / n, 6) AS x FROM m JOIN s USING (label)",
    "vec_classify": _CENTROIDS + """, c AS (SELECT label, list(x / n ORDER BY pos) AS c FROM m JOIN s USING (label) GROUP BY label
), p AS (SELECT node_id, c.label AS best_label, round(list_cosine_similarity(v, c), 6) AS score FROM nodes, c
), b AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, best_label) AS rn FROM p)
SELECT node_id, best_label, score, CASE WHEN score >= 0.3 THEN 'accept' WHEN score < 0.18 THEN 'noise' ELSE 'ask' END AS decision FROM b WHERE rn = 1""",
    "rrf_fusion": _FUSED + " SELECT node_id, round(rrf, 6) AS rrf, sources FROM fused",
    "fusion_adjust": _ADJUSTED + " SELECT node_id, round(final, 6) AS final FROM adjusted",
    "recall_unified": _ADJUSTED + """ SELECT node_id, node_id % 3 = 0 AS is_loaded, round(CASE WHEN node_id % 3 = 0 THEN final * 0.3 ELSE final END, 6) AS rank_score
FROM adjusted ORDER BY 3 DESC, 1 LIMIT 10""",
    "loaded_demotion": _ADJUSTED + """ SELECT node_id, node_id % 3 = 0 AS is_loaded,
  round(CASE WHEN node_id % 3 = 0 THEN strength * confidence * 0.3 ELSE strength * confidence END, 6) AS rank_score FROM adjusted""",
    "jaccard_boost": _SCORED + f""", {_RING}, sets AS (SELECT node_id, list_sort(list(DISTINCT neighbour)) AS ns FROM ring GROUP BY node_id
), j AS (SELECT s.node_id, round(score, 6) AS score, len(list_intersect(ns, (SELECT ns FROM sets WHERE node_id = 0))) AS i,
         len(list_distinct(list_concat(ns, (SELECT ns FROM sets WHERE node_id = 0)))) AS u FROM scored s JOIN sets USING (node_id) WHERE NOT archived AND node_id <> 0
), b AS (SELECT node_id, score, i / u AS jaccard, CASE WHEN score < 0.2 AND i / u >= 0.3 THEN score + 0.3 * (i / u) ELSE score END AS boosted FROM j WHERE score >= 0)
SELECT node_id, score, round(jaccard, 6) AS jaccard, round(boosted, 6) AS boosted FROM b WHERE b.boosted >= 0.2""",
    "spreading_activation": _SCORED + f""", {_RING}, seeds AS (SELECT node_id, score * 0.6 AS a FROM scored WHERE NOT archived ORDER BY score DESC, node_id LIMIT 10
), g AS (SELECT neighbour AS node_id, sum(a * 0.5) AS gain FROM seeds JOIN ring USING (node_id) WHERE a > 0.1 GROUP BY neighbour
), f AS (SELECT coalesce(s.node_id, g.node_id) AS node_id, s.a IS NOT NULL AS is_seed, least(1.0, coalesce(a, 0) + coalesce(gain, 0)) AS act FROM seeds s FULL JOIN g ON s.node_id = g.node_id)
SELECT node_id, is_seed, round(act, 6) AS activation FROM f WHERE is_seed OR act >= 0.01 ORDER BY act DESC, node_id LIMIT 20""",
    "similar_pairs_in_class": f"""WITH {NODES_SQL}, p AS (SELECT x.node_id AS a, y.node_id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS similarity
  FROM nodes x JOIN nodes y ON x.label = y.label AND x.node_id < y.node_id) SELECT * FROM p WHERE similarity >= 0.3""",
}
