"""Every query by name, with the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import costs as CO
from ..operators import filters as FI
from ..operators import graph as G
from ..operators import images as IM
from ..operators import joins as J
from ..operators import kernels as K
from ..operators import kdtree as KD
from ..operators import near as NE
from ..operators import paths as P
from ..operators import ranking as R
from ..operators import selection as SEL
from ..operators import skeletonize as T
from ..sources import documents as D
from ..sources import files, pages, volumes
from . import match, search
from .views import COVERED, covered, oracle, points, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None, *views: str, direct: bool = False) -> Callable[[Callable], Callable]:
    """Registers a function of the named views (``direct``: of spark and sf_dir) under its name, with its SQL."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f if direct else lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql:
            ORACLE[f.__name__] = oracle(sql, *views)
        return f

    return register


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ---- plans -------------------------------------------------------------------

_M0 = """e AS (SELECT em_id, lm_vol, (least({0}, 1.0e0) * 1.0e0 - -1.0e0) * coverage AS u FROM {1} WHERE least({0}, 1.0e0) * 1.0e0 - -1.0e0 > 0.5e0 AND coverage > 0.1e0)"""
_BOUND = """SELECT em_id, lm_vol, round(-sum(u), 6) AS bound, round(-max(u), 6) AS upper, count(*) AS n FROM e WHERE u > 0 GROUP BY 1, 2 HAVING round(-sum(u), 6) <= -40"""


@query(f"WITH {_M0.format('score_full', 'frag_score')}, b AS ({_BOUND}) SELECT em_id, lm_vol, bound, n, CAST(row_number() OVER (PARTITION BY em_id ORDER BY bound, lm_vol) - 1 AS INT) AS rank FROM b QUALIFY rank < 10", "frag_score")
def m0_rank_volumes(scores):
    return match.rank_volumes(scores)


@query(
    f"""WITH {_M0.format('score_full', 'frag_score')}, n AS ({_BOUND}), {_M0.format('score_full', 'frag_score_flipped').replace('e AS', 'e2 AS', 1)}, f AS ({_BOUND.replace('FROM e ', 'FROM e2 ')}),
    s AS (SELECT *, false AS mirrored FROM n UNION ALL SELECT *, true FROM f),
    k AS (SELECT a.em_id, a.lm_vol, a.bound AS lower, a.mirrored, a.n FROM s a LEFT JOIN s b ON a.em_id = b.em_id AND a.lm_vol = b.lm_vol AND a.mirrored <> b.mirrored WHERE b.upper IS NULL OR a.bound <= b.upper),
    o AS (SELECT * FROM k WHERE lower < 0 QUALIFY row_number() OVER (PARTITION BY em_id, lm_vol ORDER BY lower, mirrored) = 1)
    SELECT *, CAST(row_number() OVER (PARTITION BY em_id ORDER BY lower, lm_vol) - 1 AS INT) AS rank FROM o QUALIFY rank < 10""",
    "frag_score", "frag_score_flipped",
)
def m0_both_sides(normal, flipped):
    return match.rank_both_sides(normal, flipped)


_MERGED = f"""WITH {_M0.format('score_full', 'frag_score')}, r AS (SELECT *, row_number() OVER (PARTITION BY em_id ORDER BY bound, lm_vol) - 1 AS rank FROM ({_BOUND})),
    {_M0.format('score_pruned', 'frag_score').replace('e AS', 'e2 AS', 1)}, p AS (SELECT *, row_number() OVER (PARTITION BY em_id ORDER BY bound, lm_vol) - 1 AS rank FROM ({_BOUND.replace('FROM e ', 'FROM e2 ')})),
    m AS (SELECT r.em_id, r.lm_vol, r.bound, coalesce(p.rank + 10 < r.rank, false) AS nblast_pruned, CASE WHEN p.rank + 10 < r.rank THEN p.rank + 0.5e0 ELSE CAST(r.rank AS DOUBLE) END AS merged_rank FROM r LEFT JOIN p ON r.em_id = p.em_id AND r.lm_vol = p.lm_vol)
    SELECT *, CAST(row_number() OVER (PARTITION BY em_id ORDER BY merged_rank, lm_vol) - 1 AS INT) AS position FROM m"""


@query(_MERGED, "frag_score")
def m0_merged(scores):
    return match.rank_merged(scores)


# ---- sources and sinks -------------------------------------------------------

_SWC_SQL = "SELECT skel_id, node_id, 0 AS node_type, floor(x)::DOUBLE * {0} AS x, floor(y)::DOUBLE * {0} AS y, floor(z)::DOUBLE * {0} AS z, 1.0e0 * {0} AS diameter, parent_id FROM swc {1}"


def _swc_lines(swc):
    """Lines as files have them, with comments, blank lines and, for every third node, a leading blank."""
    line = F.concat_ws(" ", "node_id", F.lit(0), *[F.floor(c).cast("long") for c in "xyz"], F.lit(1), "parent_id")
    text = F.when(F.col("node_id") % 3 == 0, F.concat(F.lit(" "), line)).otherwise(line)
    return swc.select("skel_id", F.explode(F.array(text, F.lit("# comment"), F.lit(""))).alias("value"))


@query(_SWC_SQL.format("1.0e0", ""), "swc")
def src1_swc_points(swc):
    return files.parse_swc(_swc_lines(swc))


@query(_SWC_SQL.format("0.5e0", "WHERE node_id % 3 <> 0"), "swc")
def src2_swc_graph(swc):
    return files.parse_swc(_swc_lines(swc), factor=0.5, strict=True)


@query("SELECT CAST(skel_id AS VARCHAR) AS skel, count(*) AS nodes, CAST(sum(node_id) AS BIGINT) AS ids, CAST(sum(floor(x)) AS DOUBLE) AS x FROM swc GROUP BY 1", "swc")
def src3_swc_folder(swc):
    nodes = swc.select(F.col("skel_id").cast("string").alias("skel"), "node_id", F.lit(0).alias("node_type"), *[F.floor(c).cast("double").alias(c) for c in "xyz"], F.lit(1.0).alias("diameter"), "parent_id")
    path = files.work_folder(swc.sparkSession, "swc")
    files.write_swc(nodes, path)
    return files.read_swc(swc.sparkSession, path).groupBy("skel").agg(F.count("*").alias("nodes"), long(F.sum("node_id")).alias("ids"), F.sum("x").alias("x"))


def _score_documents(scores):
    """A document for each em, as the scorer writes them."""
    name = F.concat(F.lit("R"), "lm_vol", F.lit("-x_"), "frag_id")
    by_em = scores.groupBy("em_id").agg(F.map_from_entries(F.collect_list(F.struct(name, F.array("score_full", "score_pruned")))).alias("m"))
    return by_em.select(F.to_json(F.map_from_arrays(F.array(F.col("em_id").cast("string")), F.array("m"))).alias("value"))


_SCORES_SQL = "SELECT CAST(em_id AS VARCHAR) AS em, 'R' || lm_vol || '-x' AS lm_vol, CAST(frag_id AS INT) AS frag_id, round(score_full, 6) AS s0, round(score_pruned, 6) AS s1{0} FROM {1}"


@query(_SCORES_SQL.format(", 'normal' AS side", "frag_score") + " UNION ALL " + _SCORES_SQL.format(", 'flipped'", "frag_score_flipped"), "frag_score", "frag_score_flipped")
def src7_score_documents(normal, flipped):
    out = None
    for side, scores in (("normal", normal), ("flipped", flipped)):
        one = files.parse_scores(_score_documents(scores)).select("em", "lm_vol", "frag_id", F.round(F.col("scores")[0], 6).alias("s0"), F.round(F.col("scores")[1], 6).alias("s1"), F.lit(side).alias("side"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT em_id, lm_vol, frag_id, score_full FROM frag_score", "frag_score")
def src8_merge_files(scores):
    parts = [scores.filter(F.col("lm_vol") % 3 == k).select("em_id", "lm_vol", "frag_id", "score_full") for k in range(3)]
    return files.merge_scores(parts, ["em_id", "lm_vol", "frag_id"], "score_full")


@query("SELECT em_id, lm_vol, frag_id, CASE WHEN lm_vol % 3 = 1 THEN score_pruned ELSE score_full END AS score, CASE WHEN lm_vol % 3 = 2 THEN 2 ELSE 1 END AS parts FROM frag_score", "frag_score")
def src8_deep_merge(scores):
    """Nested score documents of three files merged: in the second some scores are replaced, in the third some lists go on."""
    def document(k, rows, leaf):
        inner = rows.groupBy("em_id", "lm_vol").agg(F.map_from_entries(F.collect_list(F.struct(F.col("frag_id").cast("string"), leaf))).alias("m"))
        return inner.groupBy("em_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("lm_vol").cast("string"), "m"))).alias("m")).select(F.lit(k).alias("file"), F.to_json(F.create_map(F.col("em_id").cast("string"), "m")).alias("value"))

    named = lambda score: F.create_map(F.lit("score"), F.array(score))
    single = lambda score: F.create_map(F.lit("score"), score)
    third = [scores.filter(F.col("lm_vol") % 3 == k) for k in range(3)]
    documents = document(0, third[0], single(F.col("score_full"))).unionByName(document(0, third[1], single(F.col("score_full")))).unionByName(document(0, third[2], named(F.col("score_full"))))
    documents = documents.unionByName(document(1, third[1], single(F.col("score_pruned")))).unionByName(document(2, third[2], named(F.col("score_pruned"))))
    path, values = F.col("path"), F.when(F.col("value").startswith("["), F.from_json("value", "array<double>"))  # a scalar is a broken list: dear
    score = F.coalesce(values[0], F.col("value").try_cast("double"))
    key = [path[k].cast(t).alias(c) for k, (c, t) in enumerate((("em_id", "long"), ("lm_vol", "long"), ("frag_id", "long")))]
    return D.deep_merge(documents).select(*key, score.alias("score"), F.when(F.size(values) > 1, F.size(values)).otherwise(1).alias("parts"))


@query("SELECT CAST(lm_vol AS VARCHAR) AS lm_vol, CAST(frag_id AS INT) AS frag_id, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM frag_color", "frag_color")
def src9_color_documents(colors):
    text = F.concat(F.lit("["), F.concat_ws(", ", *[F.col(c).cast("int") for c in "rgb"]), F.lit("]"))
    documents = colors.groupBy("lm_vol").agg(F.map_from_entries(F.collect_list(F.struct(F.col("frag_id").cast("string"), text))).alias("m"))
    return files.parse_colors(documents.select(F.to_json(F.map_from_arrays(F.array(F.col("lm_vol").cast("string")), F.array("m"))).alias("value")))


@query("SELECT lm_vol, frag_id, count(*) AS points, round(sum(x), 4) AS x, round(sum(y), 4) AS y, round(sum(z), 4) AS z FROM frag_point GROUP BY 1, 2", "frag_point")
def src10_fragment_points(frag_points):
    back = files.read_back(frag_points, "frag_point")
    return back.groupBy("lm_vol", "frag_id").agg(F.count("*").alias("points"), *[F.round(F.sum(c), 4).alias(c) for c in "xyz"])


@query("SELECT DISTINCT em_id, lm_vol FROM frag_score WHERE lm_vol % 4 <> 1", "frag_score")
def src11_resume(scores):
    volumes = scores.select("em_id", "lm_vol").distinct()
    done = files.read_back(volumes.filter(F.col("lm_vol") % 4 == 1), "done")
    return J.unfinished(volumes, done, ["em_id", "lm_vol"])


_CODES = "codes AS (SELECT DISTINCT CAST(em_id % 5 AS BIGINT) AS em, CAST(lm_vol % 10 AS VARCHAR) || '-x' AS code FROM frag_score WHERE lm_vol < 20)"


@query(f"WITH {_CODES} SELECT em, code, count(*) AS n FROM codes GROUP BY 1, 2", "frag_score")
def src12_must_do_list(scores):
    codes = scores.filter("lm_vol < 20").select((F.col("em_id") % 5).alias("em"), F.concat((F.col("lm_vol") % 10).cast("string"), F.lit("-x")).alias("code")).distinct()
    return files.read_back(codes, "must").groupBy("em", "code").agg(F.count("*").alias("n"))


@query("SELECT lpad(CAST(em_id % 100 AS VARCHAR), 2, '0') AS em_group, em_id, count(*) AS n, round(sum(score_full), 4) AS total FROM frag_score WHERE score_full > 0.5e0 OR score_pruned > 0.5e0 GROUP BY 1, 2", "frag_score")
def snk4_scores_by_group(scores):
    path = files.work_folder(scores.sparkSession, "scores")
    files.write_scores(scores.filter(FI.either_score(0.5, "score_full", "score_pruned")), path)
    back = scores.sparkSession.read.option("recursiveFileLookup", False).schema(scores.schema.add("em_group", "string")).parquet(path)
    return back.groupBy("em_group", "em_id").agg(F.count("*").alias("n"), F.round(F.sum("score_full"), 4).alias("total"))


@query("SELECT em_id, lm_vol, frag_id, score_full, CAST(row_number() OVER (PARTITION BY em_id ORDER BY score_full DESC, lm_vol, frag_id) - 1 AS INT) AS place FROM frag_score", "frag_score")
def snk5_sorted_scores(scores):
    back = files.read_back(R.ranked(scores, "em_id", F.col("score_full").desc(), F.col("lm_vol"), F.col("frag_id"), into="place"), "sorted")
    return back.select("em_id", "lm_vol", "frag_id", "score_full", "place")


@query("SELECT lm_vol, frag_id, r, g, b FROM frag_color", "frag_color")
def snk6_new_colors(colors):
    path = files.work_folder(colors.sparkSession, "colors")
    for half in (colors.filter("lm_vol < 5"), colors):  # the second run finds half of the volumes done
        files.save_new(half, path, ["lm_vol"])
    return colors.sparkSession.read.parquet(path)


@query(f"WITH {_M0.format('score_full', 'frag_score')} SELECT em_id, lm_vol, bound, n FROM ({_BOUND})", "frag_score")
def snk7_match_entries(scores):
    entries = match.volume_bounds(scores, match.Options()).withColumn("bound", F.round("bound", 6)).select("em_id", "lm_vol", "bound", "n")
    path = files.work_folder(scores.sparkSession, "entries")
    entries.write.json(path)
    return scores.sparkSession.read.schema(entries.schema).json(path)


@query(_MERGED, "frag_score")
def snk8_merged_ranking(scores):
    return files.read_back(match.rank_merged(scores), "merged")


@query("SELECT skel_id, node_id, concat_ws(' ', node_id, 0, CAST(floor(x) AS BIGINT), CAST(floor(y) AS BIGINT), CAST(floor(z) AS BIGINT), 1 + node_id % 5, parent_id) AS line FROM swc", "swc")
def snk10_debug_weights(swc):
    line = F.concat_ws(" ", "node_id", F.lit(0), *[F.floor(c).cast("long") for c in "xyz"], 1 + F.col("node_id") % 5, "parent_id")
    return files.read_back(swc.select("skel_id", "node_id", line.alias("line")), "debug")


@query(f"""WITH {COVERED.format(100)}, b AS (SELECT em_id, lm_vol, em_pt, frag_id FROM covered QUALIFY row_number() OVER (PARTITION BY em_id, lm_vol, em_pt ORDER BY d2, frag_id) = 1),
    v AS (SELECT DISTINCT em_id, lm_vol FROM covered)
    SELECT p.em_id, v.lm_vol, p.em_pt, CAST(coalesce(b.frag_id + 1, 0) AS BIGINT) AS winner FROM em_point p JOIN v ON v.em_id = p.em_id LEFT JOIN b ON b.em_id = p.em_id AND b.lm_vol = v.lm_vol AND b.em_pt = p.em_pt""", "em_point", "frag_point", direct=True)
def snk11_debug_coverage(spark, sf_dir):
    """The winning fragment of each target point, from 1 on; 0 where no fragment covers it."""
    c = files.read_back(covered(spark, sf_dir, 10), "covered")
    best = c.groupBy("em_id", "lm_vol", "em_pt").agg(F.min(F.struct("d2", "frag_id")).alias("b"))
    each = view(spark, sf_dir, "em_point").select("em_id", "em_pt").join(c.select("em_id", "lm_vol").distinct(), "em_id")
    return each.join(best, ["em_id", "lm_vol", "em_pt"], "left").select("em_id", "lm_vol", "em_pt", long(F.coalesce(F.col("b.frag_id") + 1, F.lit(0))).alias("winner"))


@query("SELECT 'R' || (l_partkey % 97) AS line_name, CAST(l_suppkey AS VARCHAR) AS slide_code, CAST(l_linenumber AS INT) AS rank FROM lineitem", "lineitem")
def snk12_report(lines):
    path = files.work_folder(lines.sparkSession, "report")
    files.write_report(lines.select(F.concat(F.lit("R"), F.col("l_partkey") % 97).alias("line_name"), F.col("l_suppkey").cast("string").alias("slide_code"), F.col("l_linenumber").cast("int").alias("rank")), path)
    return lines.sparkSession.read.csv(path, header=True, schema="line_name string, slide_code string, rank int")


# ---- scalar functions --------------------------------------------------------


@query("SELECT skel_id, node_id, x * 0.52e0 AS x, y * 0.52e0 AS y, z * 0.52e0 AS z, radius * 0.52e0 AS radius FROM swc", "swc")
def pr1_scale(swc):
    return swc.select("skel_id", "node_id", *[c.alias(n) for n, c in S.scaled("x", "y", "z", "radius", factor=0.52).items()])


@query("SELECT skel_id, node_id, 1427.0e0 - x AS x, y, z FROM swc", "swc")
def pr2_mirror(swc):
    return swc.select("skel_id", "node_id", S.mirrored(F.col("x")).alias("x"), "y", "z")


@query("SELECT em_id, lm_vol, frag_id, least(score_full, 0.5e0) * 1.5e0 - -1.0e0 AS score FROM frag_score", "frag_score")
def pr3_shift_score(scores):
    return scores.select("em_id", "lm_vol", "frag_id", S.shifted_score(F.col("score_full"), most=0.5, factor=1.5).alias("score"))


@query("SELECT em_id, count(*) AS n FROM frag_score WHERE score_full * 1.5e0 - -1.0e0 > -0.5e0 * 1.5e0 - -1.0e0 GROUP BY 1", "frag_score")
def pr4_threshold(scores):
    shifted = F.col("score_full") * F.lit(1.5) - F.lit(-1.0)
    return scores.filter(shifted > F.lit(S.shifted_threshold(-0.5, factor=1.5))).groupBy("em_id").agg(F.count("*").alias("n"))


@query("SELECT em_id, lm_vol, frag_id, round(greatest(score_full, score_pruned) * 100.0e0 * 1.4e0 * frag_points / 5000.0e0, 6) AS upper FROM frag_score", "frag_score")
def pr5_upper_unary(scores):
    return scores.select("em_id", "lm_vol", "frag_id", F.round(S.upper_unary(F.greatest("score_full", "score_pruned"), F.col("frag_points"), F.lit(5000.0)), 6).alias("upper"))


@query("SELECT em_id, lm_vol, frag_id, round(1.0e0 / (1.0e0 + exp(-score_full)), 9) AS s FROM frag_score", "frag_score")
def pr6_sigmoid(scores):
    return scores.select("em_id", "lm_vol", "frag_id", F.round(S.sigmoid(F.col("score_full")), 9).alias("s"))


@query("SELECT em_id, lm_vol, frag_id, round((1.0e0 / (1.0e0 + exp(coverage / 5.0e0)) + 1.0e0) * (score_full - 2.0e0) + 2.0e0, 9) AS s FROM frag_score", "frag_score")
def pr7_damp_score(scores):
    return scores.select("em_id", "lm_vol", "frag_id", F.round(S.damped_score(F.col("score_full"), F.col("coverage")), 9).alias("s"))


@query("SELECT em_id, lm_vol, frag_id, round(coverage * score_full, 9) + 0.0e0 AS u FROM frag_score", "frag_score")
def pr8_unary(scores):
    return scores.select("em_id", "lm_vol", "frag_id", (F.round(S.unary(F.col("score_full"), F.col("coverage")), 9) + F.lit(0.0)).alias("u"))


def _bright(colors):
    position = F.row_number().over(Window.partitionBy("lm_vol").orderBy("frag_id")) - 1
    placed = colors.withColumn("i", position)
    channels = S.bright_color(F.col("r"), F.col("g"), F.col("b"), F.col("i"))
    return placed.select("lm_vol", "frag_id", *[c.alias(n) for n, c in zip("rgb", channels, strict=True)])


_BRIGHT = """j AS (SELECT lm_vol, frag_id, r + 0.001e0 * (row_number() OVER o - 1) AS r, g + 0.001e0 * (row_number() OVER o - 1) AS g, b + 0.001e0 * (row_number() OVER o - 1) AS b FROM frag_color WINDOW o AS (PARTITION BY lm_vol ORDER BY frag_id)),
    n AS (SELECT lm_vol, frag_id, r * 255.0e0 / greatest(r, g, b) AS r, g * 255.0e0 / greatest(r, g, b) AS g, b * 255.0e0 / greatest(r, g, b) AS b FROM j)"""
_COST = """CASE WHEN least(a.r-b.r, a.g-b.g, a.b-b.b) > -16.0e0 OR greatest(a.r-b.r, a.g-b.g, a.b-b.b) < 16.0e0 THEN 0.1e0 * greatest(abs(a.r-b.r), abs(a.g-b.g), abs(a.b-b.b)) / 32.0e0
    ELSE (greatest(a.r-b.r, a.g-b.g, a.b-b.b) - least(a.r-b.r, a.g-b.g, a.b-b.b)) / 32.0e0 END"""
_PAIRS = f"{_BRIGHT}, p AS (SELECT a.lm_vol, a.frag_id AS a_id, b.frag_id AS b_id, {_COST} AS cost FROM n a JOIN n b ON a.lm_vol = b.lm_vol AND a.frag_id < b.frag_id)"


@query(f"WITH {_BRIGHT} SELECT lm_vol, frag_id, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM n", "frag_color")
def pr9_bright_color(colors):
    return _bright(colors).select("lm_vol", "frag_id", *[F.round(c, 6).alias(c) for c in "rgb"])


def _costs(colors):
    pairs = J.fragment_pairs(_bright(colors), "lm_vol", "frag_id")
    cost = S.color_cost(*[[F.col(f"{s}_{c}") for c in "rgb"] for s in "ab"])
    return pairs.select("lm_vol", F.col("a_frag_id").alias("a_id"), F.col("b_frag_id").alias("b_id"), cost.alias("cost"))


@query(f"WITH {_PAIRS} SELECT lm_vol, a_id, b_id, round(cost, 6) AS cost FROM p", "frag_color")
def pr10_color_cost(colors):
    return _costs(colors).withColumn("cost", S.rounded(F.col("cost"), 6))


@query("SELECT em_id, lm_vol, frag_id, round(coalesce(CASE WHEN frag_id % 5 = 0 THEN NULL ELSE coverage END * least(score_full, score_pruned), 0.0e0), 9) + 0.0e0 AS cost FROM frag_score", "frag_score")
def pr11_overlap_cost(scores):
    overlap = F.when(F.col("frag_id") % 5 != 0, F.col("coverage"))
    return scores.select("em_id", "lm_vol", "frag_id", (F.round(S.overlap_cost(overlap, F.col("score_full"), F.col("score_pruned")), 9) + F.lit(0.0)).alias("cost"))


@query("SELECT em_id, em_pt, round(seg_len * count(*) OVER w / sum(seg_len) OVER w, 9) AS seg_len FROM em_point WINDOW w AS (PARTITION BY em_id)", "em_point")
def pr12_rescale_weights(em_point):
    return A.rescaled_weights(em_point, "em_id", "seg_len").select("em_id", "em_pt", F.round("seg_len", 9).alias("seg_len"))


@query("SELECT label, z, y, x, CAST(floor((r + 32) / 64.0e0) AS BIGINT) * 64 AS r, CAST(floor((g + 32) / 64.0e0) AS BIGINT) * 64 AS g, CAST(floor((b + 32) / 64.0e0) AS BIGINT) * 64 AS b FROM voxel", "voxel")
def pr13_quantize(voxels):
    return voxels.select("label", "z", "y", "x", *[S.quantized(F.col(c)).alias(c) for c in "rgb"])


@query("WITH m AS (SELECT label, row_number() OVER (ORDER BY label) AS new FROM voxel GROUP BY label HAVING count(*) > 20 AND label <> 0 AND label % 3 <> 0) SELECT v.z, v.y, v.x, CAST(coalesce(m.new, 0) AS BIGINT) AS label FROM voxel v LEFT JOIN m USING (label)", "voxel")
def pr14_relabel(voxels):
    kept = A.label_counts(voxels, ["label"]).filter("voxels > 20 AND label <> 0 AND label % 3 <> 0")
    lookup = kept.select("label", F.row_number().over(Window.orderBy("label")).alias("new"))  # one row a label
    return voxels.join(lookup, "label", "left").select("z", "y", "x", long(F.coalesce("new", F.lit(0))).alias("label"))


_NAME = "'R' || lm_vol || '_A0-2018_' || frag_id"


@query("SELECT 'R' || lm_vol || '_A0-2018' AS lm_vol, CAST(frag_id AS INT) AS frag_id, 'R' || lm_vol || '_A0' AS line, em_id AS em FROM frag_score", "frag_score")
def pr15_parse_key(scores):
    name = F.concat(F.lit("R"), "lm_vol", F.lit("_A0-2018_"), "frag_id")
    rows = scores.select(name.alias("name"), F.concat("em_id", F.lit("-RT_18U")).alias("em"))
    volume = S.volume_of(F.col("name"))
    return rows.select(volume.alias("lm_vol"), S.fragment_of(F.col("name")).alias("frag_id"), S.line_of(volume).alias("line"), S.em_number(F.col("em")).alias("em"))


@query("SELECT DISTINCT em_id, lpad(CAST(em_id % 100 AS VARCHAR), 2, '0') AS em_group FROM frag_score", "frag_score")
def pr16_em_group(scores):
    return scores.select("em_id", S.em_group(F.col("em_id")).alias("em_group")).distinct()


@query("SELECT CAST(em_id AS VARCHAR) AS em, CAST(frag_id % 150 AS INT) AS rank, 'R' || lm_vol AS line_name, '2018' || lpad(CAST(frag_id AS VARCHAR), 6, '0') AS slide_code FROM frag_score", "frag_score")
def pr17_report_name(scores):
    slide = F.concat(F.lit("2018"), F.lpad(F.col("frag_id").cast("string"), 6, "0"))
    file = F.concat(F.lit("/out/"), "em_id", F.lit("_cr_"), F.col("frag_id") % 150, F.lit("_s_77_VT_"), "lm_vol", F.lit("_AE_01-"), slide, F.lit("-f_1_raw.png"))
    return scores.select(*[c.alias(n) for n, c in S.report_name(file).items()])


@query("SELECT label, z, y, x, CAST(floor(least(greatest(CAST(r AS DOUBLE), 0.0e0), 200.0e0) / 200.0e0 * 255.0e0) AS INT) AS v FROM voxel", "voxel")
def pr18_clip(voxels):
    return voxels.select("label", "z", "y", "x", S.clipped_intensity(F.col("r").cast("double"), F.lit(200.0)).alias("v"))


@query("SELECT lm_vol, frag_id, CAST(r AS INT) % 256 AS r, CAST(g AS INT) % 256 AS g, CAST(b AS INT) % 256 AS b FROM frag_color", "frag_color")
def pr19_hex_color(colors):
    text = F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex((F.col(c).cast("int") % 256).cast("long"))), 2, "0") for c in "rgb"])
    return colors.select("lm_vol", "frag_id", *[c.alias(n) for n, c in zip("rgb", S.hex_channels(text), strict=True)])


_RASTER = """e AS (SELECT a.skel_id, a.node_id, round_even(a.z, 0) AS az, round_even(a.y, 0) AS ay, round_even(a.x, 0) AS ax, round_even(b.z, 0) AS bz, round_even(b.y, 0) AS by_, round_even(b.x, 0) AS bx FROM swc a JOIN swc b ON a.skel_id = b.skel_id AND a.parent_id = b.node_id),
    l AS (SELECT *, greatest(abs(bz - az), abs(by_ - ay), abs(bx - ax)) AS n FROM e), k AS (SELECT *, unnest(range(1, CAST(n AS BIGINT) + 1)) AS k FROM l),
    line AS (SELECT skel_id, node_id, CAST(round_even(az + (bz - az) / n * k, 0) AS INT) AS z, CAST(round_even(ay + (by_ - ay) / n * k, 0) AS INT) AS y, CAST(round_even(ax + (bx - ax) / n * k, 0) AS INT) AS x FROM k)"""


def _raster(swc):
    e = J.edges(swc)
    line = S.line_voxels([F.col(f"l_{c}") for c in "zyx"], [F.col(f"r_{c}") for c in "zyx"])
    return e.select("skel_id", "node_id", F.explode(line).alias("v")).select("skel_id", "node_id", "v.*")


@query(f"WITH {_RASTER} SELECT * FROM line", "swc")
def pr20_raster_line(swc):
    return _raster(swc)


@query("SELECT em_id, lm_vol, frag_id, CAST(trunc(score_full * 100.0e0) AS BIGINT) AS score, CAST(trunc(coverage) AS BIGINT) AS coverage FROM frag_score", "frag_score")
def pr22_report_scale(scores):
    score, coverage = S.report_scale(F.col("score_full"), F.col("coverage"))
    return scores.select("em_id", "lm_vol", "frag_id", score.alias("score"), coverage.alias("coverage"))


@query("SELECT DISTINCT label, CASE WHEN label = 0 THEN 0 ELSE CAST(label * 7919 % 10007 % 255 + 1 AS INT) END AS r, CASE WHEN label = 0 THEN 0 ELSE CAST(label * 104729 % 20011 % 255 + 1 AS INT) END AS g, CASE WHEN label = 0 THEN 0 ELSE CAST(label * 1299709 % 30011 % 255 + 1 AS INT) END AS b FROM voxel", "voxel")
def or9_label_color(voxels):
    return voxels.select("label").distinct().select("label", *[c.alias(n) for n, c in zip("rgb", S.palette_color(F.col("label")), strict=True)])


@query(f"WITH {_BRIGHT} SELECT lm_vol, CAST(least(10, count(DISTINCT (r, g, b)) + 1) AS BIGINT) AS clusters FROM n GROUP BY 1", "frag_color")
def ml3_most_clusters(colors):
    return _bright(colors).groupBy("lm_vol").agg(long(F.least(F.lit(10), F.count_distinct("r", "g", "b") + 1)).alias("clusters"))


# ---- filters -----------------------------------------------------------------


@query("SELECT skel_id, node_id, x, y, z FROM swc WHERE x > -50e0 AND x < 50e0 AND y > -60e0 AND y < 60e0 AND z > -70e0 AND z < 70e0", "swc")
def fi1_inside_box(swc):
    return swc.filter(FI.inside_box((-50, -60, -70, 50, 60, 70))).select("skel_id", "node_id", "x", "y", "z")


@query("SELECT f.* FROM frag_point f, (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM em_point) WHERE x > ax AND x < bx AND y > ay AND y < by_ AND z > az AND z < bz", "frag_point", "em_point")
def fi2_crop(frag_point, em_point):
    return FI.crop(frag_point, "", em_point)


@query("SELECT * FROM frag_point WHERE (lm_vol, frag_id) IN (SELECT (lm_vol, frag_id) FROM frag_point GROUP BY lm_vol, frag_id HAVING count(*) > 3)", "frag_point")
def fi3_large_fragments(frag_point):
    return FI.large_groups(frag_point, ["lm_vol", "frag_id"], 3)


@query("SELECT em_id, lm_vol, frag_id FROM frag_score WHERE score_pruned > 0.9e0 OR score_full > 0.9e0", "frag_score")
def fi4_either_score(scores):
    return scores.filter(FI.either_score(0.9, "score_pruned", "score_full")).select("em_id", "lm_vol", "frag_id")


@query("SELECT em_id, lm_vol, frag_id FROM frag_score WHERE greatest(score_full, score_pruned) > -0.5e0", "frag_score")
def fi5_best_score(scores):
    return scores.filter(FI.best_score(-0.5, "score_full", "score_pruned")).select("em_id", "lm_vol", "frag_id")


@query("SELECT em_id, lm_vol, frag_id FROM frag_score WHERE greatest(score_full, score_pruned) > -0.1e0 - frag_points / 200.0e0", "frag_score")
def fi6_adaptive_score(scores):
    return scores.filter(FI.adaptive_score(-0.1, 200.0, F.greatest("score_full", "score_pruned"), F.col("frag_points"))).select("em_id", "lm_vol", "frag_id")


_UPPER = "(greatest(score_full, score_pruned) + 1.0e0) * 100.0e0 * 1.4e0 * frag_points / 5000.0e0"


def _upper():
    return S.upper_unary(F.greatest("score_full", "score_pruned") + F.lit(1.0), F.col("frag_points"), F.lit(5000.0))


@query(f"SELECT em_id, lm_vol, frag_id FROM frag_score WHERE {_UPPER} > 12.25e0 AND frag_points >= 100", "frag_score")
def fi7_upper_unary(scores):
    return scores.filter((_upper() > F.lit(12.25)) & (F.col("frag_points") >= 100)).select("em_id", "lm_vol", "frag_id")


@query(f"SELECT em_id, lm_vol, frag_id FROM frag_score WHERE (em_id, lm_vol) IN (SELECT (em_id, lm_vol) FROM frag_score GROUP BY em_id, lm_vol HAVING -sum({_UPPER}) <= -150.1234e0)", "frag_score")
def fi8_volume_by_upper(scores):
    return FI.kept_groups(scores, ["em_id", "lm_vol"], _upper(), -150.1234).select("em_id", "lm_vol", "frag_id")


@query("SELECT em_id, lm_vol, frag_id, coverage FROM frag_score WHERE coverage > 0.1e0", "frag_score")
def fi9_coverage(scores):
    return scores.filter(F.col("coverage") > 0.1).select("em_id", "lm_vol", "frag_id", "coverage")


@query("SELECT em_id, lm_vol, frag_id, 0 AS variant FROM frag_score WHERE score_full - -1.0e0 > 0.5e0 UNION ALL SELECT em_id, lm_vol, frag_id, 1 FROM frag_score WHERE score_pruned - -1.0e0 > 0.5e0", "frag_score")
def fi10_variant_score(scores):
    each = scores.select("em_id", "lm_vol", "frag_id", F.posexplode(F.array("score_full", "score_pruned")).alias("variant", "score"))
    return each.filter(S.shifted_score(F.col("score"), most=1e9) > F.lit(S.shifted_threshold(-0.5))).select("em_id", "lm_vol", "frag_id", "variant")


@query(f"WITH {COVERED.format(625)} SELECT c.em_id, lm_vol, round(100.0e0 * sum(seg_len) / min(points), 6) AS aggregate FROM (SELECT DISTINCT em_id, lm_vol, em_pt, seg_len FROM covered) c JOIN points USING (em_id) GROUP BY 1, 2 HAVING 100.0e0 * sum(seg_len) / min(points) >= 40.0001e0", "em_point", "frag_point", direct=True)
def fi11_volume_by_coverage(spark, sf_dir):
    kept = FI.covered_groups(covered(spark, sf_dir, 25), ["em_id", "lm_vol"], "em_pt", "seg_len", points(spark, sf_dir), 40.0001)
    return kept.withColumn("aggregate", F.round("aggregate", 6))


@query("SELECT em_id, lm_vol, frag_id FROM frag_score WHERE coverage * score_full > 1.01e0", "frag_score")
def fi12_unary(scores):
    return scores.filter(S.unary(F.col("score_full"), F.col("coverage")) > F.lit(1.01)).select("em_id", "lm_vol", "frag_id")


@query("SELECT em_id, lm_vol, frag_id FROM frag_score WHERE (em_id, lm_vol) IN (SELECT (em_id, lm_vol) FROM frag_score GROUP BY em_id, lm_vol HAVING -sum((score_full + 1.0e0) * coverage) <= -60.0123e0)", "frag_score")
def fi13_volume_by_unary(scores):
    return FI.kept_groups(scores, ["em_id", "lm_vol"], (F.col("score_full") + F.lit(1.0)) * F.col("coverage"), -60.0123).select("em_id", "lm_vol", "frag_id")


@query(f"""WITH {_M0.format('score_full', 'frag_score')}, n AS ({_BOUND}), {_M0.format('score_full', 'frag_score_flipped').replace('e AS', 'e2 AS', 1)}, f AS ({_BOUND.replace('FROM e ', 'FROM e2 ')}),
    s AS (SELECT *, 'normal' AS side FROM n UNION ALL SELECT *, 'flipped' FROM f)
    SELECT a.em_id, a.lm_vol, a.side, a.bound AS lower, b.upper AS other_upper FROM s a LEFT JOIN s b ON a.em_id = b.em_id AND a.lm_vol = b.lm_vol AND a.side <> b.side WHERE b.upper IS NULL OR a.bound <= b.upper""", "frag_score", "frag_score_flipped")
def fi14_skip_side(normal, flipped):
    sides = [match.volume_bounds(t, match.Options()).select("em_id", "lm_vol", F.lit(n).alias("side"), F.round("bound", 6).alias("lower"), F.round("upper", 6).alias("upper")) for n, t in (("normal", normal), ("flipped", flipped))]
    return FI.skip_worse_side(sides[0].unionByName(sides[1])).select("em_id", "lm_vol", "side", "lower", "other_upper")


_CABLE = "c AS (SELECT a.skel_id, sum(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS length FROM swc a JOIN swc b ON a.skel_id = b.skel_id AND a.parent_id = b.node_id GROUP BY 1)"


@query(f"WITH {_CABLE} SELECT skel_id FROM c WHERE length > 1000.01e0 AND skel_id <> 0", "swc")
def fi16_long_skeletons(swc):
    return A.cable_length(J.edges(swc), "skel_id").filter("length > 1000.01 AND skel_id <> 0").select("skel_id")


@query("SELECT z, y, x, label FROM voxel WHERE label IN (SELECT label FROM voxel GROUP BY label HAVING count(*) > 110)", "voxel")
def fi17_small_labels(voxels):
    return FI.large_groups(voxels, ["label"], 110).select("z", "y", "x", "label")


@query("WITH r AS (SELECT em_id, lm_vol, count(*) AS n, row_number() OVER (PARTITION BY em_id ORDER BY lm_vol) - 1 AS rank, count(*) % 9 AS size FROM frag_score GROUP BY 1, 2) SELECT em_id, lm_vol, CAST(rank AS INT) AS rank FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.em_id = a.em_id AND b.size = 0 AND b.rank <= a.rank)", "frag_score")
def fi18_until_empty(scores):
    counts = scores.groupBy("em_id", "lm_vol").agg(F.count("*").alias("n"))
    ranked = R.ranked(counts, "em_id", F.col("lm_vol"))
    return FI.before_first_empty(ranked, "em_id", "rank", F.col("n") % 9).select("em_id", "lm_vol", "rank")


@query("SELECT z, y, x, label, label IN (SELECT CAST(frag_id % 50 AS BIGINT) FROM frag_score WHERE coverage > 9.5e0 AND score_full > 0.95e0) AS selected FROM voxel", "voxel", "frag_score")
def fi19_voxel_mask(voxels, scores):
    chosen = scores.filter("coverage > 9.5 AND score_full > 0.95").select((F.col("frag_id") % 50).alias("label")).distinct()
    inside, outside = voxels.join(chosen, "label", "left_semi"), voxels.join(chosen, "label", "left_anti")
    mark = lambda t, v: t.select("z", "y", "x", "label", F.lit(v).alias("selected"))
    return mark(inside, True).unionByName(mark(outside, False))


# ---- joins -------------------------------------------------------------------

_D2 = "(e.x-f.x)*(e.x-f.x)+(e.y-f.y)*(e.y-f.y)+(e.z-f.z)*(e.z-f.z)"
_NEAR = "SELECT e.em_id, f.fp, e.em_pt, {0} AS d2 FROM em_point e, frag_point f WHERE {0} <= {1}"


@query(f"WITH p AS ({_NEAR.format(_D2, 625)}) SELECT fp, em_id, em_pt, round(d2, 6) AS d2 FROM p QUALIFY row_number() OVER (PARTITION BY fp ORDER BY p.d2, em_id, em_pt) = 1", "em_point", "frag_point")
def jo1_nearest(em_point, frag_point):
    return J.nearest(frag_point, em_point, 25, ["fp"], ["em_id", "em_pt"]).select("fp", "em_id", "em_pt", F.round("d2", 6).alias("d2"))


@query(f"SELECT CAST(f.frag_id AS INT) AS em_id, f.fp, e.em_pt, round({_D2}, 6) AS d2 FROM em_point e JOIN frag_point f ON e.em_id = f.frag_id QUALIFY row_number() OVER (PARTITION BY f.fp ORDER BY {_D2}, e.em_pt) = 1", "em_point", "frag_point")
def jo1_nearest_unbounded(em_point, frag_point):
    """The nearest point of its own target for each fragment point, however far."""
    found = KD.nearest_in_group(frag_point.withColumn("em_id", F.col("frag_id").cast("int")), em_point, ["em_id"], "fp", "em_pt")
    return found.withColumn("d2", F.round("d2", 6))


@query(f"SELECT e.em_id, e.em_pt, f.fp, round({_D2}, 6) AS d2 FROM em_point e JOIN frag_point f ON e.em_id = f.frag_id", "em_point", "frag_point")
def jo2_all_distances(em_point, frag_point):
    targets, fragments = em_point.select("em_id", "em_pt", *"xyz"), frag_point.select(F.col("frag_id").cast("int").alias("em_id"), "fp", *"xyz")
    return J.all_distances(targets, fragments, ["em_id"]).select("em_id", "em_pt", "fp", S.rounded(F.col("d2"), 6).alias("d2"))


@query(f"SELECT fp FROM frag_point f WHERE EXISTS (SELECT 1 FROM em_point e WHERE {_D2} <= 100)", "em_point", "frag_point")
def jo3_near_points(em_point, frag_point):
    return J.near_points(frag_point, em_point, 10, ["fp"]).select("fp")


def _nearest_sql(k, radius2, op, by, tie):
    return f"WITH p AS ({_NEAR.format(_D2, radius2).replace('<= ' + str(radius2), op + ' ' + str(radius2))}) SELECT em_id, em_pt, fp, round(d2, 6) AS d2, CAST(row_number() OVER (PARTITION BY {by} ORDER BY p.d2, {tie}) AS INT) AS nth FROM p QUALIFY nth <= {k}"


def _fragments_to_targets(em_point, frag_point, k, **options):
    """For each fragment point the k nearest points of every target."""
    found = KD.k_nearest_within(frag_point, em_point, 25, k, ["fp"], ["em_pt"], each=("em_id",), **options)
    return found.select("em_id", "em_pt", "fp", F.round("d2", 6).alias("d2"), "nth")


@query(_nearest_sql(15, 625, "<", "em_id, fp", "em_pt"), "em_point", "frag_point")
def jo4_fifteen_nearest(em_point, frag_point):
    return _fragments_to_targets(em_point, frag_point, 15, strict=True)


@query(_nearest_sql(50, 625, "<=", "em_id, fp", "em_pt"), "em_point", "frag_point")
def jo5_fifty_within(em_point, frag_point):
    return _fragments_to_targets(em_point, frag_point, 50)


@query(_nearest_sql(25, 625, "<=", "em_id, em_pt", "fp"), "em_point", "frag_point")
def jo6_fragments_near_target(em_point, frag_point):
    found = KD.k_nearest_within(em_point, frag_point, 25, 25, ["em_id", "em_pt"], ["fp"])
    return found.select("em_id", "em_pt", "fp", F.round("d2", 6).alias("d2"), "nth")


@query("SELECT s.em_id, s.lm_vol, s.frag_id, s.score_full, c.r, c.g, c.b FROM frag_score s JOIN frag_color c ON s.frag_id = c.frag_id", "frag_score", "frag_color")
def jo11_lookup(scores, colors):
    return J.checked_lookup(scores.select("em_id", "lm_vol", "frag_id", "score_full"), colors.drop("lm_vol"), ["frag_id"]).select("em_id", "lm_vol", "frag_id", "score_full", "r", "g", "b")


_SIDES = "n AS (SELECT em_id, lm_vol, count(*) AS n, max(score_full) AS best FROM frag_score GROUP BY 1, 2), f AS (SELECT em_id, lm_vol, count(*) AS n, max(score_full) AS best FROM frag_score_flipped GROUP BY 1, 2)"


def _sides(normal, flipped):
    return [t.groupBy("em_id", "lm_vol").agg(F.count("*").alias("n"), F.max("score_full").alias("best")) for t in (normal, flipped)]


@query(f"WITH {_SIDES} SELECT em_id, lm_vol, CAST(n.n AS DOUBLE) AS normal_n, n.best AS normal_best, CAST(f.n AS DOUBLE) AS flipped_n, f.best AS flipped_best FROM n FULL JOIN f USING (em_id, lm_vol)", "frag_score", "frag_score_flipped")
def jo12_both_sides(normal, flipped):
    both = J.both_sides(*_sides(normal, flipped), ["em_id", "lm_vol"])
    return both.withColumns({c: F.col(c).cast("double") for c in ("normal_n", "flipped_n")})


@query(f"WITH {_SIDES} SELECT f.* FROM f WHERE (em_id, lm_vol) NOT IN (SELECT (em_id, lm_vol) FROM n)", "frag_score", "frag_score_flipped")
def jo13_unfinished(normal, flipped):
    n, f = _sides(normal, flipped)
    return J.unfinished(f, n, ["em_id", "lm_vol"])


@query(f"WITH {_CODES}, v AS (SELECT DISTINCT 'R' || lm_vol || '-x' AS volume FROM frag_score) SELECT em, code, volume FROM v JOIN codes ON contains(volume, code)", "frag_score")
def jo14_must_do(scores):
    codes = scores.filter("lm_vol < 20").select((F.col("em_id") % 5).alias("em"), F.concat((F.col("lm_vol") % 10).cast("string"), F.lit("-x")).alias("code")).distinct()
    volumes = scores.select(F.concat(F.lit("R"), "lm_vol", F.lit("-x")).alias("volume")).distinct()
    return J.containing(volumes, codes, "volume", "code").select("em", "code", "volume")


_RANKS = "r AS (SELECT em_id, lm_vol, row_number() OVER (PARTITION BY em_id ORDER BY max(score_full) DESC, lm_vol) - 1 AS rank FROM frag_score GROUP BY 1, 2), p AS (SELECT em_id, lm_vol, row_number() OVER (PARTITION BY em_id ORDER BY max(score_pruned) DESC, lm_vol) - 1 AS rank FROM frag_score WHERE frag_id % 3 = 0 GROUP BY 1, 2)"


def _two_ranks(scores):
    one = lambda t, s: R.ranked(t.groupBy("em_id", "lm_vol").agg(F.max(s).alias("s")), "em_id", F.col("s").desc(), F.col("lm_vol")).select("em_id", "lm_vol", "rank")
    return one(scores, "score_full"), one(scores.filter("frag_id % 3 = 0"), "score_pruned")


@query(f"WITH {_RANKS} SELECT r.em_id, r.lm_vol, CAST(r.rank AS INT) AS rank, CAST(p.rank AS DOUBLE) AS pruned_rank FROM r LEFT JOIN p ON r.em_id = p.em_id AND r.lm_vol = p.lm_vol", "frag_score")
def jo15_two_rankings(scores):
    regular, pruned = _two_ranks(scores)
    return regular.join(pruned.select("em_id", "lm_vol", F.col("rank").cast("double").alias("pruned_rank")), ["em_id", "lm_vol"], "left")


@query("SELECT a.lm_vol, a.frag_id AS a_id, b.frag_id AS b_id FROM frag_color a JOIN frag_color b ON a.lm_vol = b.lm_vol AND a.frag_id < b.frag_id", "frag_color")
def jo16_fragment_pairs(colors):
    return J.fragment_pairs(colors.select("lm_vol", "frag_id"), "lm_vol", "frag_id").select("lm_vol", F.col("a_frag_id").alias("a_id"), F.col("b_frag_id").alias("b_id"))


@query("SELECT a.skel_id, a.node_id, a.parent_id, b.x AS parent_x FROM swc a JOIN swc b ON a.skel_id = b.skel_id AND a.parent_id = b.node_id", "swc")
def jo17_parent_edges(swc):
    return J.edges(swc).select("skel_id", "node_id", "parent_id", F.col("r_x").alias("parent_x"))


@query("SELECT em_id, lm_vol, frag_id FROM frag_score WHERE lm_vol % 7 <> 0", "frag_score")
def or6_skip_existing(scores):
    path = files.work_folder(scores.sparkSession, "skip")
    keys = scores.select("em_id", "lm_vol", "frag_id")
    files.save_new(keys.filter("lm_vol % 7 = 0"), path, ["lm_vol"])
    return J.unfinished(keys, scores.sparkSession.read.parquet(path).select("lm_vol").distinct(), ["lm_vol"])


# ---- aggregates --------------------------------------------------------------


def _coverage_sql(radius2, body):
    return f"WITH {COVERED.format(radius2)} {body}"


def _rounded(rows, *keys):
    return rows.select(*keys, F.round("coverage", 6).alias("coverage"))


@query(_coverage_sql(625, "SELECT c.em_id, lm_vol, frag_id, round(100.0e0 * sum(seg_len) / min(points), 6) AS coverage FROM covered c JOIN points USING (em_id) GROUP BY 1, 2, 3"), "em_point", "frag_point", direct=True)
def ag1_fragment_coverage(spark, sf_dir):
    return _rounded(A.fragment_coverage(covered(spark, sf_dir, 25), points(spark, sf_dir), "em_id", ["lm_vol", "frag_id"], "seg_len"), "em_id", "lm_vol", "frag_id")


@query(_coverage_sql(625, "SELECT c.em_id, lm_vol, round(100.0e0 * sum(seg_len) / min(points), 6) AS coverage FROM (SELECT DISTINCT em_id, lm_vol, em_pt, seg_len FROM covered) c JOIN points USING (em_id) GROUP BY 1, 2"), "em_point", "frag_point", direct=True)
def ag2_aggregate_coverage(spark, sf_dir):
    return _rounded(A.aggregate_coverage(covered(spark, sf_dir, 25), points(spark, sf_dir), "em_id", ["lm_vol"], "em_pt", "seg_len"), "em_id", "lm_vol")


@query(_coverage_sql(625, "SELECT c.em_id, lm_vol, round(100.0e0 * count(DISTINCT em_pt) / min(points), 6) AS coverage FROM covered c JOIN points USING (em_id) GROUP BY 1, 2"), "em_point", "frag_point", direct=True)
def ag3_point_coverage(spark, sf_dir):
    return _rounded(A.point_coverage(covered(spark, sf_dir, 25), points(spark, sf_dir), "em_id", ["lm_vol"], "em_pt"), "em_id", "lm_vol")


_ADJUSTED = "best AS (SELECT em_id, lm_vol, frag_id, em_pt, seg_len FROM covered WHERE frag_id % 4 - 1 > 0 QUALIFY row_number() OVER (PARTITION BY em_id, lm_vol, em_pt ORDER BY frag_id % 4 DESC, frag_id) = 1), adjusted AS (SELECT b.em_id, lm_vol, frag_id, 100.0e0 * sum(seg_len) / min(points) AS coverage FROM best b JOIN points USING (em_id) GROUP BY 1, 2, 3)"


def _adjusted(spark, sf_dir, c):
    return A.adjusted_coverage(c.withColumn("value", F.col("frag_id") % 4 - 1), points(spark, sf_dir), "em_id", ["lm_vol"], "frag_id", "em_pt", "seg_len", "value")


@query(_coverage_sql(625, "SELECT em_id, lm_vol, frag_id, round(coverage, 6) AS coverage FROM adjusted").replace(" SELECT em_id, lm_vol, frag_id, round(coverage", f", {_ADJUSTED} SELECT em_id, lm_vol, frag_id, round(coverage"), "em_point", "frag_point", direct=True)
def ag4_adjusted_coverage(spark, sf_dir):
    return _rounded(_adjusted(spark, sf_dir, covered(spark, sf_dir, 25)), "em_id", "lm_vol", "frag_id")


@query(f"WITH {COVERED.format(625)}, b AS (SELECT * FROM covered WHERE d2 < 400 QUALIFY row_number() OVER (PARTITION BY em_id, lm_vol, em_pt ORDER BY d2, frag_id) = 1) SELECT b.em_id, lm_vol, frag_id, round(100.0e0 * sum(seg_len) / min(points), 6) AS coverage FROM b JOIN points USING (em_id) GROUP BY 1, 2, 3", "em_point", "frag_point", direct=True)
def ag5_nearest_coverage(spark, sf_dir):
    return _rounded(A.nearest_coverage(covered(spark, sf_dir, 25), points(spark, sf_dir), "em_id", ["lm_vol"], "frag_id", "em_pt", "seg_len", 400), "em_id", "lm_vol", "frag_id")


@query(f"WITH {COVERED.format(625)}, k AS (SELECT *, 1.0e0 / count(*) OVER (PARTITION BY em_id, lm_vol, em_pt) AS s FROM covered) SELECT k.em_id, lm_vol, frag_id, round(100.0e0 * sum(s) / min(points), 6) AS coverage FROM k JOIN points USING (em_id) GROUP BY 1, 2, 3", "em_point", "frag_point", direct=True)
def ag6_shared_coverage(spark, sf_dir):
    return _rounded(A.shared_coverage(files.read_back(covered(spark, sf_dir, 25), "covered"), points(spark, sf_dir), "em_id", ["lm_vol"], "frag_id", "em_pt"), "em_id", "lm_vol", "frag_id")


@query("SELECT label, count(*) AS voxels FROM voxel GROUP BY 1", "voxel")
def ag7_label_counts(voxels):
    return A.label_counts(voxels, ["label"])


@query("SELECT label, round(CASE WHEN label = 0 THEN 40.0e0 ELSE sqrt(CAST((max(z)-min(z)+1)*(max(z)-min(z)+1)+(max(y)-min(y)+1)*(max(y)-min(y)+1)+(max(x)-min(x)+1)*(max(x)-min(x)+1) AS DOUBLE)) END, 9) AS diagonal FROM voxel GROUP BY 1", "voxel")
def ag8_label_diagonals(voxels):
    return A.label_diagonals(voxels, ["label"], "label", 20).withColumn("diagonal", F.round("diagonal", 9))


@query("WITH q AS (SELECT label, CAST(floor((r + 32) / 64.0e0) AS BIGINT) * 64 AS r, CAST(floor((g + 32) / 64.0e0) AS BIGINT) * 64 AS g, CAST(floor((b + 32) / 64.0e0) AS BIGINT) * 64 AS b FROM voxel), n AS (SELECT label, r, g, b, count(*) AS n FROM q GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, r, g, b) = 1", "voxel")
def ag10_color_mode(voxels):
    return A.color_mode(voxels, ["label"])


@query(f"WITH {COVERED.format(625)}, {_ADJUSTED}, u AS (SELECT c.em_id, lm_vol, -max((frag_id % 4 - 1) * cov) AS upper FROM (SELECT c.em_id, lm_vol, frag_id, 100.0e0 * sum(seg_len) / min(points) AS cov FROM covered c JOIN points USING (em_id) GROUP BY 1, 2, 3) c GROUP BY 1, 2), l AS (SELECT em_id, lm_vol, -sum((frag_id % 4 - 1) * coverage) AS lower FROM adjusted GROUP BY 1, 2) SELECT u.em_id, u.lm_vol, round(upper, 6) AS upper, round(lower, 6) AS lower FROM u JOIN l USING (em_id, lm_vol)", "em_point", "frag_point", direct=True)
def ag11_bounds(spark, sf_dir):
    c = files.read_back(covered(spark, sf_dir, 25), "covered")
    value = F.col("frag_id") % 4 - 1
    single = A.fragment_coverage(c, points(spark, sf_dir), "em_id", ["lm_vol", "frag_id"], "seg_len").withColumn("u", value * F.col("coverage"))
    adjusted = _adjusted(spark, sf_dir, c).withColumn("a", value * F.col("coverage"))
    return A.bounds(single, adjusted, ["em_id", "lm_vol"], "u", "a").select("em_id", "lm_vol", F.round("upper", 6).alias("upper"), F.round("lower", 6).alias("lower"))


@query("SELECT skel_id, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM swc GROUP BY 1", "swc")
def ag12_box(swc):
    return A.box(swc, ["skel_id"])


@query("WITH e AS (SELECT skel_id, node_id AS n FROM swc WHERE parent_id <> -1 UNION ALL SELECT skel_id, parent_id FROM swc WHERE parent_id <> -1) SELECT s.skel_id, s.node_id, count(e.n) AS degree FROM swc s LEFT JOIN e ON s.skel_id = e.skel_id AND s.node_id = e.n GROUP BY 1, 2", "swc")
def ag13_degrees(swc):
    return G.degrees(swc)


@query("SELECT em_id, lm_vol, frag_id, list_max([score_full, score_pruned]) AS best FROM frag_score", "frag_score")
def ag14_best_variant(scores):
    return scores.select("em_id", "lm_vol", "frag_id", F.array_max(F.array("score_full", "score_pruned")).alias("best"))


@query("SELECT em_id, lm_vol, string_agg(CAST(frag_id AS VARCHAR), ',' ORDER BY frag_id) AS fragments FROM frag_score GROUP BY 1, 2", "frag_score")
def ag15_fragments_of_volume(scores):
    return scores.groupBy("em_id", "lm_vol").agg(F.array_join(F.array_sort(F.collect_list("frag_id")), ",").alias("fragments"))


@query("SELECT y, x, max(r) AS intensity, CAST(arg_max(z, (r, -z)) AS INT) AS depth FROM voxel GROUP BY 1, 2", "voxel")
def ag16_projection(voxels):
    return A.projection(voxels, [], F.col("r")).withColumn("depth", F.col("depth").cast("int"))


@query("SELECT round(greatest(quantile_cont(r::DOUBLE, 0.99), quantile_cont(g::DOUBLE, 0.99), quantile_cont(b::DOUBLE, 0.99)), 6) AS clip, 'all' AS kind FROM voxel UNION ALL SELECT round(greatest(quantile_cont(r::DOUBLE, 0.9) FILTER (r > 0), quantile_cont(g::DOUBLE, 0.9) FILTER (g > 0), quantile_cont(b::DOUBLE, 0.9) FILTER (b > 0)), 6), 'positive' FROM voxel", "voxel")
def ag17_clip_value(voxels):
    every, positive = A.clip_value(voxels, 0.99, list("rgb")), A.clip_value(voxels, 0.9, list("rgb"), positive=True)
    return every.withColumn("kind", F.lit("all")).unionByName(positive.withColumn("kind", F.lit("positive"))).withColumn("clip", F.round("clip", 6))


def _scaled(c: str, clip: str) -> str:
    return f"CAST(floor(least(greatest(CAST({c} AS DOUBLE), 0.0e0), {clip}) / {clip} * 255.0e0) AS INT)"


_VIEW = """drawn AS (SELECT DISTINCT y, x FROM line), largest AS (SELECT y, x, max(r) AS r, max(g) AS g, max(b) AS b FROM voxel {0} GROUP BY 1, 2)"""
_DRAWN = "SELECT coalesce(p.y, s.y) AS y, coalesce(p.x, s.x) AS x, {0} FROM bright p FULL JOIN drawn s ON p.y = s.y AND p.x = s.x"


def _painted(*color: int) -> str:
    return _DRAWN.format(", ".join(f"CASE WHEN s.y IS NULL THEN {c} ELSE {v} END AS {c}" for c, v in zip("rgb", color, strict=True)))


_CLIP = "clip AS (SELECT greatest(" + ", ".join(f"quantile_cont({c}::DOUBLE, 0.9) FILTER ({c} > 0)" for c in "rgb") + ") AS clip FROM largest)"
_NOT_BLACK = ", ".join(f"CASE {_scaled(c, 'clip')} WHEN 0 THEN 100 ELSE {_scaled(c, 'clip')} END AS {c}" for c in "rgb")


@query(f"WITH {_RASTER}, {_VIEW.format('WHERE label % 2 = 0')}, {_CLIP}, bright AS (SELECT y, x, {_NOT_BLACK} FROM largest, clip) {_painted(255, 0, 255)}", "voxel", "swc")
def gr10_overlay(voxels, swc):
    """The projection of a match's fragments with the target drawn on it."""
    return IM.overlay(voxels.filter("label % 2 = 0"), _raster(swc))


@query(
    f"""WITH {_RASTER}, back AS (SELECT y, x, CAST(max(r) AS DOUBLE) AS v, arg_max(z, (r, -z)) AS z FROM voxel GROUP BY 1, 2), front AS (SELECT y, x, min(z) AS own FROM line GROUP BY 1, 2),
    halo AS (SELECT DISTINCT y + a AS y, x + b AS x, true AS near FROM line, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)), every AS (SELECT y, x FROM back UNION SELECT y, x FROM halo)
    SELECT y, x, round(CASE WHEN own IS NOT NULL THEN own / 8.0e0 ELSE coalesce(z / 8.0e0, 0) END, 6) AS depth,
           round(CASE WHEN own IS NOT NULL THEN 255.0e0 WHEN near THEN 0.0e0 ELSE {_scaled('v', '200.0e0')} / 2.5e0 END, 6) AS intensity,
           CASE WHEN own IS NOT NULL THEN 'skeleton' WHEN near THEN 'halo' ELSE 'volume' END AS layer
    FROM every LEFT JOIN back USING (y, x) LEFT JOIN halo USING (y, x) LEFT JOIN front USING (y, x)""",
    "voxel", "swc",
)
def gr10_depth(voxels, swc):
    """The depth at which a channel is brightest, with the target and its halo."""
    line = _raster(swc)
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    halo = line.select("y", "x").distinct().withColumn("o", F.explode(steps)).select((F.col("y") + F.col("o.a")).alias("y"), (F.col("x") + F.col("o.b")).alias("x"))
    out = IM.depth_view(voxels, line, halo, channel="r", depth=8, clip=200.0)
    return out.withColumns({"depth": F.round("depth", 6), "intensity": F.round("intensity", 6)})


_SIZE = "s AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM voxel), d AS (SELECT DISTINCT label, y, x FROM voxel WHERE label <> 0)"
_NEAR8 = "(SELECT unnest([-1, 0, 1]) AS a) i, (SELECT unnest([-1, 0, 1]) AS b) j"


def _image_shape(voxels) -> list[int]:
    return [int(m) + 1 for m in voxels.agg(F.max("y"), F.max("x")).first()]


@query(
    f"""WITH {_SIZE}, n AS (SELECT d.label, d.y, d.x, d.y + a AS ny, d.x + b AS nx FROM d, {_NEAR8}),
    e AS (SELECT n.label, n.y, n.x FROM n CROSS JOIN s LEFT JOIN d ON d.label = n.label AND d.y = ny AND d.x = nx WHERE d.y IS NULL AND ny BETWEEN 0 AND h - 1 AND nx BETWEEN 0 AND w - 1),
    o AS (SELECT y, x, max(label) AS label FROM e GROUP BY 1, 2), g AS (SELECT y, x, CAST(floor(max(r) / 510.0e0 * 255.0e0) AS INT) AS v FROM voxel GROUP BY 1, 2)
    SELECT coalesce(o.y, g.y) AS y, coalesce(o.x, g.x) AS x, CASE WHEN o.y IS NULL THEN v ELSE CAST(label * 7919 % 10007 % 255 + 1 AS INT) END AS r,
           CASE WHEN o.y IS NULL THEN v ELSE CAST(label * 104729 % 20011 % 255 + 1 AS INT) END AS g, CASE WHEN o.y IS NULL THEN v ELSE CAST(label * 1299709 % 30011 % 255 + 1 AS INT) END AS b
    FROM g FULL JOIN o ON o.y = g.y AND o.x = g.x""",
    "voxel",
)
def gr10_outline(voxels):
    """The outlines of all labels, seen along the depth, over the raw image."""
    return IM.outlines(voxels.select("label", "y", "x").distinct(), _image_shape(voxels), voxels.groupBy("y", "x").agg(F.max("r").alias("v")))


@query(
    f"""WITH {_SIZE}, c AS (SELECT d.label, d.y, d.x, min(greatest(abs(d.y - q.y), abs(d.x - q.x))) AS distance
      FROM d CROSS JOIN s, LATERAL (SELECT d.y + a AS y, d.x + b AS x FROM (SELECT unnest(range(-3, 4)) AS a) i, (SELECT unnest(range(-3, 4)) AS b) j) q
      WHERE q.y BETWEEN 0 AND h - 1 AND q.x BETWEEN 0 AND w - 1 AND NOT EXISTS (SELECT 1 FROM d z WHERE z.label = d.label AND z.y = q.y AND z.x = q.x) GROUP BY 1, 2, 3)
    SELECT label, y, x, CAST(distance AS INT) AS distance FROM c WHERE distance <= 3""",
    "voxel",
)
def gr9_distances(voxels):
    """How far inside its label each pixel is, up to three steps."""
    return IM.distances(voxels.filter("label <> 0"), ["label"], ["y", "x"], _image_shape(voxels), most=3)


@query(f"WITH {_RASTER}, {_VIEW.format('')}, bright AS (SELECT y, x, {', '.join(f'{_scaled(c, '510.0e0')} AS {c}' for c in 'rgb')} FROM largest) {_painted(0, 255, 255)}", "voxel", "swc")
def or10_viewer(voxels, swc):
    """A whole volume's projection with a skeleton on it."""
    return IM.viewer(voxels, _raster(swc))


@query("SELECT label, CASE WHEN avg(r) >= avg(g) AND avg(r) >= avg(b) THEN 0 WHEN avg(g) >= avg(b) THEN 1 ELSE 2 END AS channel FROM voxel GROUP BY 1", "voxel")
def ag18_best_channel(voxels):
    return A.best_channel(voxels, ["label"])


@query(f"WITH {_PAIRS}, ends AS (SELECT lm_vol, a_id AS frag_id, cost FROM p UNION ALL SELECT lm_vol, b_id, cost FROM p) SELECT lm_vol, frag_id, round(sum(cost), 4) AS cost FROM ends GROUP BY 1, 2", "frag_color")
def ag19_sum_of_costs(colors):
    return CO.cost_sums(_bright(colors), "lm_vol", "frag_id").withColumn("cost", F.round("cost", 4))


@query(f"WITH {_PAIRS}, ends AS (SELECT lm_vol, a_id AS frag_id, cost FROM p UNION ALL SELECT lm_vol, b_id, cost FROM p), s AS (SELECT lm_vol, frag_id, sum(cost) AS cost, frag_id % 13 AS u FROM ends GROUP BY 1, 2) SELECT lm_vol, round(-sum(u) + 0.5e0 / (count(*) - 1) * sum(u * cost), 4) AS energy FROM s GROUP BY 1", "frag_color")
def ag20_energy(colors):
    """The energy of choosing all fragments of a volume, for a unary that depends on the id."""
    each = CO.cost_sums(_bright(colors), "lm_vol", "frag_id").withColumn("u", F.col("frag_id") % 13)
    return each.groupBy("lm_vol").agg(F.round(-F.sum("u") + F.lit(0.5) / (F.count("*") - 1) * F.sum(F.col("u") * F.col("cost")), 4).alias("energy"))


@query(f"WITH {_CABLE} SELECT skel_id, round(length, 6) AS length FROM c", "swc")
def ag21_cable_length(swc):
    return A.cable_length(J.edges(swc), "skel_id").withColumn("length", F.round("length", 6))


@query("SELECT DISTINCT label FROM voxel WHERE label <> 0", "voxel")
def ag22_labels(voxels):
    return voxels.filter("label <> 0").select("label").distinct()


@query("SELECT lm_vol % 5 AS cluster, count(*) AS size FROM frag_score GROUP BY 1", "frag_score")
def ag23_cluster_sizes(scores):
    return scores.groupBy((F.col("lm_vol") % 5).alias("cluster")).agg(F.count("*").alias("size"))


@query("SELECT em_id, lm_vol, frag_id, max(score_full) AS score_full FROM (SELECT em_id, lm_vol, frag_id, score_full FROM frag_score UNION ALL SELECT em_id, lm_vol + 1000, frag_id, score_full FROM frag_score_flipped) GROUP BY 1, 2, 3", "frag_score", "frag_score_flipped")
def dg1_merge(normal, flipped):
    cols = ["em_id", "lm_vol", "frag_id", "score_full"]
    return files.merge_scores([normal.select(cols), flipped.withColumn("lm_vol", F.col("lm_vol") + 1000).select(cols), normal.select(cols)], cols[:3], "score_full")


# ---- ranking, sets -----------------------------------------------------------


@query("SELECT em_id, lm_vol, frag_id, CAST(row_number() OVER (PARTITION BY em_id ORDER BY score_full DESC, lm_vol, frag_id) - 1 AS INT) AS rank FROM frag_score", "frag_score")
def so1_scores_of_target(scores):
    return R.ranked(scores, "em_id", F.col("score_full").desc(), F.col("lm_vol"), F.col("frag_id")).select("em_id", "lm_vol", "frag_id", "rank")


_ENERGY = "e AS (SELECT em_id, lm_vol, round(-sum(coverage * score_full), 6) + 0.0e0 AS cov_score FROM frag_score GROUP BY 1, 2)"


def _energies(scores):
    return scores.groupBy("em_id", "lm_vol").agg((F.round(-F.sum(F.col("coverage") * F.col("score_full")), 6) + F.lit(0.0)).alias("cov_score"))


@query(f"WITH {_ENERGY} SELECT em_id, lm_vol, CAST(row_number() OVER (PARTITION BY em_id ORDER BY cov_score, lm_vol) AS INT) AS place FROM e", "frag_score")
def so2_matches_of_target(scores):
    ranked = R.ranked(_energies(scores), "em_id", F.col("cov_score"), F.col("lm_vol"))
    return ranked.select("em_id", "lm_vol", (F.col("rank") + 1).alias("place"))


@query(f"WITH {_ENERGY} SELECT em_id, lm_vol, CAST(row_number() OVER (PARTITION BY em_id ORDER BY cov_score, lm_vol) - 1 AS INT) AS rank FROM e", "frag_score")
def so3_rank(scores):
    return R.ranked(_energies(scores), "em_id", F.col("cov_score"), F.col("lm_vol")).select("em_id", "lm_vol", "rank")


@query(f"WITH {_RANKS}, m AS (SELECT r.em_id, r.lm_vol, coalesce(p.rank + 10 < r.rank, false) AS nblast_pruned, CASE WHEN p.rank + 10 < r.rank THEN p.rank + 0.5e0 ELSE CAST(r.rank AS DOUBLE) END AS merged_rank FROM r LEFT JOIN p ON r.em_id = p.em_id AND r.lm_vol = p.lm_vol) SELECT *, CAST(row_number() OVER (PARTITION BY em_id ORDER BY merged_rank, lm_vol) - 1 AS INT) AS position FROM m", "frag_score")
def so4_merge_ranks(scores):
    return R.merged_ranks(*_two_ranks(scores), "em_id", "lm_vol").select("em_id", "lm_vol", "nblast_pruned", "merged_rank", "position")


@query(f"WITH {_ENERGY} SELECT em_id, lm_vol, cov_score, CAST(row_number() OVER (PARTITION BY em_id ORDER BY cov_score, lm_vol) - 1 AS INT) AS rank FROM e QUALIFY rank < 7", "frag_score")
def so5_top(scores):
    return R.top(_energies(scores), "em_id", 7, F.col("cov_score"), F.col("lm_vol"))


@query("WITH s AS (SELECT em_id, lm_vol, round(-sum(coverage * score_full), 6) AS energy, 0 AS side FROM frag_score GROUP BY 1, 2 UNION ALL SELECT em_id, lm_vol, round(-sum(coverage * score_full), 6), 1 FROM frag_score_flipped GROUP BY 1, 2) SELECT em_id, lm_vol, energy, side FROM s WHERE energy < 0 QUALIFY row_number() OVER (PARTITION BY em_id, lm_vol ORDER BY energy, side) = 1", "frag_score", "frag_score_flipped")
def so6_best_of(normal, flipped):
    both = [_energies(t).select("em_id", "lm_vol", F.col("cov_score").alias("energy"), F.lit(k).alias("side")) for k, t in enumerate((normal, flipped))]
    return R.best_of(both[0].unionByName(both[1]), ["em_id", "lm_vol"], "energy", "side")


@query(f"WITH {_ENERGY}, p AS (SELECT em_id, lm_vol, row_number() OVER (PARTITION BY em_id ORDER BY cov_score, lm_vol) - 1 AS position FROM e) SELECT em_id, lm_vol, CAST(position AS INT) AS position, CAST(position // 8 AS INT) AS page FROM p", "frag_score")
def so7_pages(scores):
    return R.paged(_energies(scores), "em_id", F.col("cov_score"), F.col("lm_vol"), size=8).select("em_id", "lm_vol", "position", "page")


@query(_nearest_sql(6, 625, "<=", "em_id, fp", "em_pt"), "em_point", "frag_point")
def so8_six_nearest(em_point, frag_point):
    return _fragments_to_targets(em_point, frag_point, 6)


@query("SELECT em_id, lm_vol, frag_id, score_full FROM frag_score QUALIFY row_number() OVER (PARTITION BY em_id ORDER BY score_full, lm_vol, frag_id) <= 5", "frag_score")
def so9_smallest(scores):
    return R.top(scores, "em_id", 5, F.col("score_full"), F.col("lm_vol"), F.col("frag_id")).select("em_id", "lm_vol", "frag_id", "score_full")


@query("SELECT em_id, lm_vol, string_agg(CAST(frag_id AS VARCHAR), ',' ORDER BY score_full, frag_id) AS ascending FROM frag_score GROUP BY 1, 2", "frag_score")
def so10_argsort(scores):
    pairs = F.array_sort(F.collect_list(F.struct("score_full", "frag_id")))
    return scores.groupBy("em_id", "lm_vol").agg(F.array_join(F.transform(pairs, lambda p: p["frag_id"].cast("string")), ",").alias("ascending"))


@query(f"WITH {_ENERGY}, r AS (SELECT em_id, lm_vol, lm_vol % 6 AS line, row_number() OVER (PARTITION BY em_id ORDER BY cov_score, lm_vol) - 1 AS rank FROM e), f AS (SELECT *, min(rank) OVER (PARTITION BY em_id, line) AS first FROM r) SELECT em_id, lm_vol, line, CAST(row_number() OVER (PARTITION BY em_id ORDER BY first, line, rank) - 1 AS INT) AS bookmark FROM f", "frag_score")
def so12_bookmarks(scores):
    ranked = R.ranked(_energies(scores), "em_id", F.col("cov_score"), F.col("lm_vol")).withColumn("line", F.col("lm_vol") % 6)
    return R.by_line(ranked, "em_id", "line", "rank").select("em_id", "lm_vol", "line", "bookmark")


@query(f"WITH {_ENERGY} SELECT CAST(em_id AS VARCHAR) AS name, count(*) AS pages FROM e GROUP BY 1", "frag_score")
def snk14_pages(scores):
    """A document of pages with bookmarks for each target, its pages by line."""
    ranked = R.ranked(_energies(scores), "em_id", F.col("cov_score"), F.col("lm_vol")).withColumn("line", F.col("lm_vol") % 6)
    rows = R.by_line(ranked, "em_id", "line", "rank")
    texts = [F.concat(F.lit(label), F.col(c).cast("string")) for label, c in (("EM: ", "em_id"), ("LM: Line Name ", "line"), ("rank: ", "rank"))]
    pages_ = rows.select(F.col("em_id").cast("string").alias("name"), F.col("bookmark").cast("int").alias("position"), F.concat_ws(": ", "rank", "lm_vol").alias("bookmark"), F.col("line").cast("string").alias("line"), F.array(*texts).alias("lines"), F.array().cast("array<string>").alias("images"))
    return files.read_back(pages.write_pdf(pages_, files.work_folder(scores.sparkSession, "pages")), "documents")


@query("SELECT lm_vol FROM frag_score UNION SELECT lm_vol FROM frag_score_flipped", "frag_score", "frag_score_flipped")
def se1_union(normal, flipped):
    return normal.select("lm_vol").union(flipped.select("lm_vol")).distinct()


@query("SELECT lm_vol, count(*) AS n FROM (SELECT DISTINCT lm_vol FROM frag_score UNION ALL SELECT DISTINCT lm_vol FROM frag_score_flipped WHERE lm_vol % 2 = 0) GROUP BY 1", "frag_score", "frag_score_flipped")
def se2_append(normal, flipped):
    bag = normal.select("lm_vol").distinct().unionAll(flipped.filter("lm_vol % 2 = 0").select("lm_vol").distinct())
    return bag.groupBy("lm_vol").agg(F.count("*").alias("n"))


@query("SELECT em_id, CAST(count(DISTINCT lm_vol) AS BIGINT) AS volumes FROM frag_score GROUP BY 1", "frag_score")
def se3_unique(scores):
    return scores.select("em_id", "lm_vol").distinct().groupBy("em_id").agg(F.count("*").alias("volumes"))


@query("SELECT DISTINCT lm_vol FROM frag_score_flipped EXCEPT SELECT lm_vol FROM frag_score", "frag_score", "frag_score_flipped")
def se4_except(normal, flipped):
    return flipped.select("lm_vol").subtract(normal.select("lm_vol"))


@query(f"WITH {_ENERGY} SELECT v.em_id, v.lm_vol, coalesce(e.cov_score, 0.0e0) AS cov_score FROM (SELECT DISTINCT em_id, lm_vol FROM frag_score_flipped) v LEFT JOIN e ON v.em_id = e.em_id AND v.lm_vol = e.lm_vol", "frag_score", "frag_score_flipped")
def se5_defaults(normal, flipped):
    return R.with_defaults(flipped.select("em_id", "lm_vol").distinct(), _energies(normal), ["em_id", "lm_vol"], "cov_score")


# ---- graphs ------------------------------------------------------------------

_ROOTED = "r AS (SELECT skel_id, node_id, node_id AS root, 0 AS hops FROM swc WHERE parent_id = -1 UNION ALL SELECT s.skel_id, s.node_id, r.root, r.hops + 1 FROM swc s JOIN r ON s.skel_id = r.skel_id AND s.parent_id = r.node_id)"


@query(f"WITH RECURSIVE {_ROOTED} SELECT skel_id, node_id, min(node_id) OVER (PARTITION BY skel_id, root) AS component FROM r", "swc")
def gr4_components(swc):
    return G.components(swc)


@query(f"WITH RECURSIVE {_ROOTED} SELECT skel_id, node_id AS leaf, CAST(hops AS BIGINT) AS hops FROM r QUALIFY row_number() OVER (PARTITION BY skel_id ORDER BY r.hops DESC, node_id) = 1", "swc")
def gr5_spine(swc):
    return G.spine(swc)


@query(f"WITH {_RASTER}, d AS (SELECT DISTINCT skel_id, z, y, x FROM line) SELECT DISTINCT d.skel_id, CAST(d.z + o.z AS INT) AS z, CAST(d.y + o.y AS INT) AS y, CAST(d.x + o.x AS INT) AS x FROM d, (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(z, y, x)", "swc")
def gr9_dilated_mask(swc):
    """Voxels of the skeletons' lines, dilated by one step along the axes."""
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("zyx", o, strict=True)]) for o in ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))])
    once = _raster(swc).select("skel_id", "z", "y", "x").distinct().withColumn("o", F.explode(steps))
    return once.select("skel_id", *[(F.col(c) + F.col(f"o.{c}")).cast("int").alias(c) for c in "zyx"]).distinct()


# ---- kernels: tested against brute force and by hand -------------------------


def _coverage_kernel(version: str):
    def run(em_point, frag_point):
        return K.coverage(em_point, frag_point, 25, version=version)

    return run


for _name, _version in (("jo7_greedy_coverage", ""), ("jo8_optimal_v1", "ilp_v1"), ("jo8_optimal_v2", "ilp_v2"), ("jo8_optimal_v3", "ilp_v3"), ("jo9_mixed_v1", "mixed_v1"), ("jo9_mixed_v2", "mixed_v2")):
    QUERIES[_name] = lambda spark, sf_dir, f=_coverage_kernel(_version): f(view(spark, sf_dir, "em_point"), view(spark, sf_dir, "frag_point"))


#: A table of scores that falls with distance and rises with alignment.
_DISTANCES, _ANGLES = np.array([0.0, 2, 5, 10, 20, 40, 80]), np.linspace(0, 0.9, 10)
_TABLE = np.linspace(1, -1, len(_DISTANCES))[:, None] * np.linspace(0.5, 1, len(_ANGLES))[None]
_DOTPROPS = "skel_id long, node_id long, x double, y double, z double, tx double, ty double, tz double"


def _similarity(queries, targets):
    return K.similarity(queries, targets, _TABLE, _DISTANCES, _ANGLES)


def _all_pairs(swc):
    d = K.per_skeleton(swc, K.dotprops(5), _DOTPROPS)
    return _similarity(d, d)


@query(None, "swc")
def jo10_similarity(swc):
    """Every skeleton against every other."""
    return _all_pairs(swc)


@query(None, "swc")
def jo10_normalized(swc):
    """The same, divided by a skeleton's score against itself."""
    return K.normalized(files.read_back(_all_pairs(swc), "pairs"))


#: Beyond the last edge any two points score the same.
_NEAR_DISTANCES = np.array([0.0, 2, 5, 10, 20])
_NEAR_TABLE = np.vstack([np.linspace(1, -0.5, len(_NEAR_DISTANCES) - 1)[:, None] * np.linspace(0.5, 1, len(_ANGLES))[None], np.full((1, len(_ANGLES)), -1.0)])


@query(None, "swc")
def jo10_near(swc):
    """Every skeleton against every other, the kernel on pairs that share a cell only."""
    d = files.read_back(K.per_skeleton(swc, K.dotprops(5), _DOTPROPS), "dotprops")
    return NE.similarity_of_near(d, d, _NEAR_TABLE, _NEAR_DISTANCES, _ANGLES)


@query(None, "voxel")
def ag9_color_centers(voxels):
    return SEL.color_modes(voxels, ["label"])


@query(None, "swc")
def gr1_peeled_weights(swc):
    return K.per_skeleton(swc, K.weigh, "skel_id long, node_id int, weight double")


@query(None, "swc")
def gr2_pruned(swc):
    return K.per_skeleton(swc, K.prune(60.0, 3), "skel_id long, node_id int")


_RELABEL = """e AS (SELECT a.skel_id, a.node_id AS a, b.node_id AS b FROM swc a JOIN swc b ON a.skel_id = b.skel_id AND (a.parent_id = b.node_id OR b.parent_id = a.node_id)),
    s AS (SELECT skel_id, coalesce(min(a) FILTER (WHERE degree = 1), min(a)) AS a FROM (SELECT skel_id, a, count(*) AS degree FROM e GROUP BY 1, 2) GROUP BY 1),
    v AS (SELECT skel_id, a AS n, -1 AS prev, printf('%09d', a) AS path FROM s
          UNION ALL SELECT v.skel_id, e.b, v.n, v.path || printf('%09d', e.b) FROM v JOIN e ON e.skel_id = v.skel_id AND e.a = v.n AND e.b <> v.prev),
    o AS (SELECT skel_id, n AS node_id, prev, CAST(row_number() OVER (PARTITION BY skel_id ORDER BY path) AS INT) AS new_id FROM v),
    r AS (SELECT o.skel_id, o.node_id, o.new_id, coalesce(p.new_id, -1) AS new_parent FROM o LEFT JOIN o p ON p.skel_id = o.skel_id AND p.node_id = o.prev)"""


@query(f"WITH RECURSIVE {_RELABEL} SELECT CAST(skel_id AS BIGINT) AS skel_id, node_id, new_id, new_parent FROM r", "swc")
def gr3_relabelled(swc):
    return K.per_skeleton(swc, K.relabel, "skel_id long, node_id int, new_id int, new_parent int")


@query(
    """WITH e AS (SELECT s.skel_id, s.node_id, s.x, s.y, s.z, p.x AS px, p.y AS py, p.z AS pz, greatest(1, CAST(ceil(sqrt((s.x-p.x)*(s.x-p.x)+(s.y-p.y)*(s.y-p.y)+(s.z-p.z)*(s.z-p.z)) / 10.0e0 - 1e-9) AS INT)) AS n
               FROM swc s JOIN swc p ON p.skel_id = s.skel_id AND p.node_id = s.parent_id),
    i AS (SELECT *, unnest(range(1, n + 1)) AS i FROM e)
    SELECT skel_id, node_id, px + (x-px) * (i / n) AS x, py + (y-py) * (i / n) AS y, pz + (z-pz) * (i / n) AS z FROM i
    UNION ALL SELECT skel_id, node_id, x, y, z FROM swc s WHERE NOT EXISTS (SELECT 1 FROM swc p WHERE p.skel_id = s.skel_id AND p.node_id = s.parent_id)""",
    "swc",
)
def gr6_resampled(swc):
    return G.resampled(swc, 10.0)


_EDGES = """e AS (SELECT a.skel_id, a.node_id AS a, b.node_id AS b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM swc a JOIN swc b ON a.skel_id = b.skel_id AND (a.parent_id = b.node_id OR b.parent_id = a.node_id))"""


@query(
    f"""WITH RECURSIVE {_EDGES},
    w AS (SELECT skel_id, a AS src, a AS prev, b AS cur, [a, b] AS way, [0.0e0, d] AS ats FROM e WHERE (SELECT count(*) FROM e g WHERE g.skel_id = e.skel_id AND g.a = e.a) = 1
          UNION ALL SELECT w.skel_id, w.src, w.cur, e.b, list_append(w.way, e.b), list_append(w.ats, w.ats[-1] + e.d) FROM w JOIN e ON e.skel_id = w.skel_id AND e.a = w.cur AND e.b <> w.prev),
    l AS (SELECT * FROM w WHERE src < cur QUALIFY row_number() OVER (PARTITION BY skel_id ORDER BY round(ats[-1], 9) DESC, src, cur) = 1)
    SELECT skel_id, way[i] AS node_id, CASE WHEN i = 1 THEN -1 ELSE way[i - 1] END AS parent_id, round(ats[i], 6) AS at FROM l, unnest(range(1, len(way) + 1)) u(i)""",
    "swc",
)
def gr5_spine_skeleton(swc):
    """The longest path of each skeleton, by length, as a skeleton."""
    return P.spine(swc).select("skel_id", "node_id", "parent_id", F.round("at", 6).alias("at"))


@query(
    """WITH RECURSIVE c AS (SELECT skel_id, parent_id AS node_id, count(*) AS n FROM swc WHERE parent_id <> -1 GROUP BY 1, 2),
    k AS (SELECT s.*, s.parent_id = -1 OR coalesce(c.n, 0) <> 1 AS key, coalesce(sqrt((s.x-p.x)*(s.x-p.x)+(s.y-p.y)*(s.y-p.y)+(s.z-p.z)*(s.z-p.z)), 0) AS edge, p.x AS px, p.y AS py, p.z AS pz
          FROM swc s LEFT JOIN c USING (skel_id, node_id) LEFT JOIN swc p ON p.skel_id = s.skel_id AND p.node_id = s.parent_id),
    r AS (SELECT k.skel_id, k.node_id, k.node_id AS top, k.parent_id AS upper, k.edge AS arc, k.key FROM k JOIN k u ON u.skel_id = k.skel_id AND u.node_id = k.parent_id AND u.key
          UNION ALL SELECT k.skel_id, k.node_id, r.top, r.upper, r.arc + k.edge, k.key FROM r JOIN k ON k.skel_id = r.skel_id AND k.parent_id = r.node_id WHERE NOT r.key),
    t AS (SELECT skel_id, top, upper, node_id AS lower, arc AS total, CASE WHEN arc > 10.0e0 THEN greatest(CAST(ceil(arc / 10.0e0 - 1e-9) AS BIGINT) - 1, 0) ELSE 0 END AS n FROM r WHERE key),
    b AS (SELECT t.*, coalesce(sum(n) OVER (PARTITION BY t.skel_id ORDER BY top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + g.most AS base FROM t JOIN (SELECT skel_id, max(node_id) AS most FROM swc GROUP BY 1) g USING (skel_id)),
    x AS (SELECT r.*, k.edge, k.x, k.y, k.z, k.px, k.py, k.pz, k.parent_id, b.total, b.n, b.base FROM r JOIN k USING (skel_id, node_id) JOIN b USING (skel_id, top)),
    i AS (SELECT *, unnest(range(CAST(floor((arc - edge) / 10.0e0 + 1e-9) AS BIGINT) + 1, least(CAST(floor(arc / 10.0e0 + 1e-9) AS BIGINT), n) + 1)) AS j FROM x WHERE total > 10.0e0),
    o AS (SELECT skel_id, base + j AS node_id, CASE WHEN j = 1 THEN upper ELSE base + j - 1 END AS parent_id, px + (x - px) * f AS x, py + (y - py) * f AS y, pz + (z - pz) * f AS z FROM (SELECT *, CASE WHEN edge > 0 THEN (j * 10.0e0 - (arc - edge)) / edge ELSE 0 END AS f FROM i)
          UNION ALL SELECT skel_id, node_id, CASE WHEN total <= 10.0e0 THEN parent_id WHEN n > 0 THEN base + n ELSE upper END, x, y, z FROM x WHERE key OR total <= 10.0e0
          UNION ALL SELECT skel_id, node_id, -1, x, y, z FROM swc WHERE parent_id = -1)
    SELECT skel_id, CAST(node_id AS BIGINT) AS node_id, CAST(parent_id AS BIGINT) AS parent_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM o""",
    "swc",
)
def gr6_resampled_segments(swc):
    """Skeletons with even points along whole segments; what comes out is a skeleton again."""
    return P.resampled(swc, 10.0).select("skel_id", "node_id", "parent_id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(None, "swc")
def gr8_dotprops(swc):
    return K.per_skeleton(swc, K.dotprops(5), _DOTPROPS)


@query(f"WITH RECURSIVE {_RELABEL} SELECT CAST(r.skel_id AS VARCHAR) AS skel, r.new_id AS node_id, s.x, s.y, s.z, r.new_parent AS parent_id FROM r JOIN swc s ON s.skel_id = r.skel_id AND s.node_id = r.node_id", "swc")
def snk1_write_swc(swc):
    """Relabelled skeletons written as text, a file each, and read back."""
    new = K.per_skeleton(swc, K.relabel, "skel_id long, node_id int, new_id int, new_parent int")
    rows = new.join(swc.select("skel_id", "node_id", "x", "y", "z"), ["skel_id", "node_id"])
    nodes = rows.select(F.col("skel_id").cast("string").alias("skel"), F.col("new_id").alias("node_id"), F.lit(0).alias("node_type"), "x", "y", "z", F.lit(1.0).alias("diameter"), F.col("new_parent").alias("parent_id"))
    path = files.work_folder(swc.sparkSession, "written")
    files.write_swc(nodes, path)
    return files.read_swc(swc.sparkSession, path).select("skel", "node_id", "x", "y", "z", "parent_id")


def _entries(spark, sf_dir, clustering: str):
    c = files.read_back(covered(spark, sf_dir, 25), "covered")
    pairs = c.select("em_id", "lm_vol", "frag_id").distinct()
    score = F.lit(0.5) + (F.col("frag_id") * 7 + F.col("em_id")) % 10 / F.lit(10.0)
    channel = lambda m: ((F.col("frag_id") * m + F.col("lm_vol")) % 255 + 1).cast("double")
    fragments = pairs.select("em_id", "lm_vol", "frag_id", score.alias("score"), channel(37).alias("r"), channel(91).alias("g"), channel(53).alias("b"))
    return SEL.best_fragments(c, fragments, points(spark, sf_dir), clustering=clustering)


@query(None, direct=True)
def ml6_match_agglomerative(spark, sf_dir):
    """Target by volume: colour clusters (ML2), removal with its skip rules (ML4, FI15), and the entry."""
    return _entries(spark, sf_dir, "agglomerative")


@query(None, direct=True)
def ml6_match_kmeans(spark, sf_dir):
    """The same with k-means clusters (ML1)."""
    return _entries(spark, sf_dir, "kmeans")


# ---- volumes -----------------------------------------------------------------

_ONE = "SELECT z, y, x, max(label) AS label, max(r) AS r, max(g) AS g, max(b) AS b FROM voxel GROUP BY 1, 2, 3"


def _one_per_place(voxels):
    return voxels.groupBy("z", "y", "x").agg(*[F.max(c).alias(c) for c in ("label", "r", "g", "b")])


def _shape(voxels) -> list[int]:
    return [int(m) + 1 for m in voxels.agg(*[F.max(c) for c in "zyx"]).first()]


@query(f"WITH o AS ({_ONE}) SELECT z, y, x, r, g, b FROM o WHERE r > 0 OR g > 0 OR b > 0", "voxel")
def src5_raw_volume(voxels):
    """A raw volume written as a chunked array and loaded."""
    one = _one_per_place(voxels)
    path = files.work_folder(voxels.sparkSession, "raw")
    channels = one.select("z", "y", "x", F.posexplode(F.array("r", "g", "b")).alias("c", "v"))
    volumes.write_zarr(channels, path, "volumes/raw", ["c", "z", "y", "x"], "v", [3, *_shape(one)], [1, 8, 32, 256], "|u1")
    return volumes.load_raw(voxels.sparkSession, path)


@query(f"WITH o AS ({_ONE}) SELECT z, y, x, label FROM o WHERE label > 0", "voxel")
def src6_label_volume(voxels):
    one = _one_per_place(voxels)
    path = files.work_folder(voxels.sparkSession, "labels")
    volumes.write_zarr(one, path, "volumes", ["z", "y", "x"], "label", _shape(one), [4, 16, 128])
    return volumes.load_labels(voxels.sparkSession, path)


@query(f"WITH o AS ({_ONE}) SELECT z, y, x, label FROM o WHERE label IN (SELECT label FROM o WHERE label > 0 GROUP BY label HAVING count(*) > 100)", "voxel")
def snk9_filtered_volume(voxels):
    """Labels of few voxels removed, the rest written once: a second run finds the array there."""
    one = _one_per_place(voxels)
    kept = FI.large_groups(one.filter("label > 0"), ["label"], 100)
    path = files.work_folder(voxels.sparkSession, "filtered")
    if not volumes.write_zarr(kept, path, "volumes", ["z", "y", "x"], "label", _shape(one), [4, 16, 128]) or volumes.write_zarr(one, path, "volumes", ["z", "y", "x"], "label", _shape(one), [4, 16, 128]):
        raise RuntimeError("an array is written once")
    return volumes.load_labels(voxels.sparkSession, path)


@query("SELECT l_suppkey % 10 AS em, 'R' || (l_partkey % 97) AS line_name, CAST(l_linenumber AS INT) AS rank FROM lineitem", "lineitem")
def snk13_report_per_target(lines):
    """A report folder for each target."""
    rows = lines.select((F.col("l_suppkey") % 10).alias("em"), F.concat(F.lit("R"), F.col("l_partkey") % 97).alias("line_name"), F.col("l_linenumber").cast("int").alias("rank"))
    path = files.work_folder(lines.sparkSession, "reports")
    rows.repartition("em").sortWithinPartitions("em", "rank").write.partitionBy("em").csv(path, header=True)
    return lines.sparkSession.read.csv(path, header=True, schema="line_name string, rank int, em long").select("em", "line_name", "rank")


@query("SELECT em_id, lm_vol, '{\"frag_ids\":[' || string_agg(CAST(frag_id AS VARCHAR), ',' ORDER BY frag_id) || ']}' AS entry FROM frag_score GROUP BY 1, 2", "frag_score")
def pr21_entry_as_json(scores):
    ids = scores.groupBy("em_id", "lm_vol").agg(F.array_sort(F.collect_list("frag_id")).alias("frag_ids"))
    return ids.select("em_id", "lm_vol", F.to_json(F.struct("frag_ids")).alias("entry"))


@query(None, "swc")
def src4_cached_dotprops(swc):
    """Tangents computed once and read from then on."""
    path = files.work_folder(swc.sparkSession, "dotprops")
    for _ in range(2):
        out = volumes.cached(K.per_skeleton(swc, K.dotprops(3), _DOTPROPS), path)
    return out


@query(None, "swc")
def gr7_skeletonized(swc):
    """Skeletons of the dilated lines of the given skeletons: voxels to nodes again."""
    tube = gr9_dilated_mask(swc).filter("skel_id <> 0").withColumn("label", F.col("skel_id"))
    return T.skeletonize(tube, ["label"], least_cable=20.0)


_WALK = """e AS (SELECT a.skel_id, a.node_id AS a, b.node_id AS b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM swc a JOIN swc b ON a.skel_id = b.skel_id AND (a.parent_id = b.node_id OR b.parent_id = a.node_id)),
    g AS (SELECT skel_id, a AS n, count(*) AS degree FROM e GROUP BY 1, 2),
    w AS (SELECT e.skel_id, e.a AS tip, e.a AS prev, e.b AS cur, e.d AS len FROM e JOIN g ON g.skel_id = e.skel_id AND g.n = e.a AND g.degree = 1
          UNION ALL SELECT w.skel_id, w.tip, w.cur, e.b, w.len + e.d FROM w JOIN g ON g.skel_id = w.skel_id AND g.n = w.cur AND g.degree = 2 JOIN e ON e.skel_id = w.skel_id AND e.a = w.cur AND e.b <> w.prev),
    t AS (SELECT skel_id, tip FROM w GROUP BY 1, 2 HAVING max(len) <= 150.0e0),
    x AS (SELECT DISTINCT w.skel_id, unnest([w.tip, CASE WHEN g.degree <= 2 THEN w.cur ELSE w.tip END]) AS n FROM w JOIN t ON t.skel_id = w.skel_id AND t.tip = w.tip JOIN g ON g.skel_id = w.skel_id AND g.n = w.cur)"""


@query(f"WITH RECURSIVE {_WALK} SELECT s.skel_id, s.node_id FROM swc s LEFT JOIN x ON x.skel_id = s.skel_id AND x.n = s.node_id WHERE x.n IS NULL", "swc")
def gr2_pruned_once(swc):
    return K.per_skeleton(swc, K.prune(150.0, 1), "skel_id int, node_id int")


@query(None, direct=True)
def e2e_search(spark, sf_dir):
    """The whole search on the derived points and a mirrored second side: fragments scored against each target and against the
    target without its short branches, then filtered, covered, matched and ranked."""
    em, normal, swc = (view(spark, sf_dir, name) for name in ("em_point", "frag_point", "swc"))
    flipped = normal.withColumn("x", S.mirrored(F.col("x"), 0))
    frags = normal.withColumn("side", F.lit("normal")).unionByName(flipped.withColumn("side", F.lit("flipped")))
    key = ("side", "lm_vol", "frag_id")
    sizes = frags.groupBy(*key).agg(F.count("*").alias("frag_points")).withColumn("query", F.xxhash64(*key))
    queries = K.per_skeleton(frags.select(F.xxhash64(*key).alias("skel_id"), F.col("fp").cast("long").alias("node_id"), *"xyz"), K.dotprops(3), _DOTPROPS)
    queries = files.read_back(queries, "queries")  # once for both forms of the targets
    whole = em.select(F.col("em_id").cast("long").alias("skel_id"), F.col("em_pt").cast("long").alias("node_id"), *"xyz")
    left = K.per_skeleton(swc, K.prune(60.0, 3), "skel_id long, node_id long")
    scored = lambda targets, name: _similarity(queries, K.per_skeleton(targets, K.dotprops(5), _DOTPROPS)).withColumnRenamed("score", name)
    scores = scored(whole, "score_full").join(scored(whole.join(left, ["skel_id", "node_id"], "left_semi"), "score_pruned"), ["query", "target"], "left")
    scores = scores.join(sizes, "query").select(F.col("target").cast("int").alias("em_id"), *key, "frag_points", "score_full", F.coalesce("score_pruned", F.lit(-1.0)).alias("score_pruned"))
    channel = lambda m: ((F.col("frag_id") * m + F.col("lm_vol")) % 255 + 1).cast("double")
    colors = normal.select("lm_vol", "frag_id").distinct().select("lm_vol", "frag_id", channel(37).alias("r"), channel(91).alias("g"), channel(53).alias("b"))
    return search.ranked(search.entries(files.read_back(scores, "scores"), em, frags, colors))
