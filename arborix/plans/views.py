"""Skeletons, fragments, scores and voxels derived from the star-schema tables, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> (tables or views it reads, SQL that both engines run). {i} is the index of a list's first element.
DEFINITIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "skel_node": (("embeddings",), "SELECT vec_id, label AS skel_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INT) AS node_id, CAST(embedding[{0}] AS DOUBLE) * 100 AS x, CAST(embedding[{1}] AS DOUBLE) * 100 AS y, CAST(embedding[{2}] AS DOUBLE) * 100 AS z FROM embeddings"),
    "swc": (("skel_node",), "SELECT skel_id, node_id, x, y, z, 1.0e0 AS radius, CAST(CASE WHEN node_id = 1 THEN -1 WHEN node_id % 7 = 0 THEN node_id - 5 ELSE node_id - 1 END AS INT) AS parent_id FROM skel_node"),
    "em_point": (("skel_node",), "SELECT CAST(skel_id AS INT) AS em_id, node_id AS em_pt, x, y, z, CAST(1 + node_id % 5 AS DOUBLE) AS seg_len FROM skel_node WHERE vec_id % 2 = 0"),
    "frag_point": (("skel_node",), "SELECT CAST(vec_id % 10 AS INT) AS lm_vol, skel_id AS frag_id, vec_id AS fp, x, y, z FROM skel_node WHERE vec_id % 2 = 1"),
    "frag_score": (("lineitem",), "SELECT CAST(l_suppkey AS BIGINT) AS em_id, l_orderkey % 50 AS lm_vol, l_partkey AS frag_id, MAX(l_quantity / 25.0e0 - 1.0e0) AS score_full, MAX(l_tax / 0.04e0 - 1.0e0) AS score_pruned, CAST(MAX(FLOOR(l_extendedprice / 100.0e0)) AS BIGINT) AS frag_points, MAX(l_discount * 100.0e0) AS coverage FROM lineitem GROUP BY 1, 2, 3"),
    "frag_score_flipped": (("lineitem",), "SELECT CAST(l_suppkey AS BIGINT) AS em_id, (l_orderkey + 1) % 60 AS lm_vol, l_partkey AS frag_id, MAX(1.0e0 - l_quantity / 25.0e0) AS score_full, MAX(1.0e0 - l_tax / 0.04e0) AS score_pruned, CAST(MAX(FLOOR(l_extendedprice / 100.0e0)) AS BIGINT) AS frag_points, MAX(l_discount * 100.0e0) AS coverage FROM lineitem GROUP BY 1, 2, 3"),
    "voxel": (("lineitem",), "SELECT l_partkey % 50 AS label, CAST(l_linenumber AS INT) AS z, CAST(FLOOR(l_quantity) AS INT) AS y, CAST(l_suppkey AS INT) AS x, CAST(FLOOR(l_extendedprice) AS BIGINT) % 256 AS r, l_partkey % 256 AS g, l_orderkey % 256 AS b FROM lineitem"),
    "frag_color": (("part",), "SELECT p_partkey % 10 AS lm_vol, p_partkey AS frag_id, CAST(p_size * 5 AS DOUBLE) AS r, CAST((p_partkey * 37) % 255 + 1 AS DOUBLE) AS g, CAST((p_partkey * 91) % 255 + 1 AS DOUBLE) AS b FROM part"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the directory."""
    if name not in DEFINITIONS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    (source,), text = DEFINITIONS[name]
    return spark.sql(text.format(0, 1, 2).replace(f"FROM {source}", "FROM {source}"), source=view(spark, sf_dir, source))


def oracle(body: str, *names: str) -> str:
    """SQL with the views that it names before it."""
    needed: dict[str, str] = {}

    def need(name: str) -> None:
        if name in DEFINITIONS and name not in needed:
            sources, text = DEFINITIONS[name]
            for s in sources:
                need(s)
            needed[name] = text.format(1, 2, 3)

    for name in names:
        need(name)
    ctes = ",\n".join(f"{n} AS ({t})" for n, t in needed.items())
    body = body.strip()
    if not needed:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


def covered(spark: SparkSession, sf_dir: str, radius: float) -> DataFrame:
    """(em_id, lm_vol, frag_id, em_pt, seg_len, d2): target points within the radius of a fragment, nearest pair each, weights rescaled."""
    from ..operators import aggregates, kdtree

    em = aggregates.rescaled_weights(view(spark, sf_dir, "em_point"), "em_id", "seg_len")
    found = kdtree.k_nearest_within(em, view(spark, sf_dir, "frag_point"), radius, 1, ["em_id", "em_pt", "seg_len"], ["fp"], each=("lm_vol", "frag_id"))
    return found.select("em_id", "lm_vol", "frag_id", "em_pt", "seg_len", "d2")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "em_point").groupBy("em_id").agg(F.count("*").alias("points"))


#: The SQL of ``covered`` and ``points``, with a place for the squared radius.
COVERED = """w AS (SELECT em_id, em_pt, x, y, z, seg_len * count(*) OVER (PARTITION BY em_id) / sum(seg_len) OVER (PARTITION BY em_id) AS seg_len FROM em_point),
points AS (SELECT em_id, count(*) AS points FROM em_point GROUP BY 1),
covered AS (SELECT w.em_id, f.lm_vol, f.frag_id, w.em_pt, min(w.seg_len) AS seg_len, min((w.x-f.x)*(w.x-f.x)+(w.y-f.y)*(w.y-f.y)+(w.z-f.z)*(w.z-f.z)) AS d2
            FROM w, frag_point f WHERE (w.x-f.x)*(w.x-f.x)+(w.y-f.y)*(w.y-f.y)+(w.z-f.z)*(w.z-f.z) <= {0} GROUP BY 1, 2, 3, 4)"""
