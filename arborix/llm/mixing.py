"""Mixing sources to target weights by systematic sampling.

A source's documents stand in a fixed order; each is expected ``rate`` times
(target over source size), and the prefix sums of what is expected, plus one
random offset in [0, 1) for each source, cross an integer boundary once for
every copy that the mix takes. Rates are equal within a source, so a prefix sum
is the rate times the document's rank, and the rank comes from counts of strata
(source, class of size, salt) plus a row number within the stratum: no source,
however large, stands in one task. Sizes rise over the odd classes and fall
over the even ones: both ends of the order are small documents, so that what the
offset moves weighs little and the words taken stay near the target.

Defined cases: null and empty texts have size 0 and are sampled like others;
null sources form the last source; a source whose size is 0 has target 0;
repeated rows are separate documents; an empty table gives an empty result;
columns named like a result are replaced.
Reruns agree: order and offsets are functions of the rows and the seed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def _sizes(texts: pa.Array) -> pa.Array:
    return pa.array([len(t.split()) if t else 0 for t in common.utf8(texts)], pa.int64())


def size_of(text: str = "text") -> Column:
    """Words between blanks (``[\\x20\\x09-\\x0D]``); null has none."""
    return common.arrow_udf("mixing", _sizes, "long")(F.col(f"`{text}`"))


def targets(totals: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from a row per source: ``share`` of all sizes by weight, no target over
    ``most`` times its source's size, the excess shared again by weight.

    Sources reach their limit in the order of limit over weight; a running sum over
    that order finds the level at which the others fill up. One row a source is all that meets here.
    """
    numbered = totals.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")).cast("long")
    limits = numbered.withColumns({"w": weight, "cap": F.lit(most) * F.col("source_size")})
    order = Window.orderBy(F.col("cap") / F.col("w"), "i")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = limits.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0)),
        "goal": F.lit(share) * F.sum("source_size").over(everything), "w_all": F.sum("w").over(everything),
    }).withColumn("level", (F.col("goal") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
    open_ = F.when(F.col("level") < F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "i", "level"))
    level = F.min(open_).over(everything)["level"]
    return filled.withColumn("target", F.coalesce(F.least(F.col("cap"), level * F.col("w")), F.col("cap"))).select("source", "source_size", "target")


def unit(key: Column) -> Column:
    """A number in [0, 1) from 31 bits of a keyed digest."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF)) / F.lit(float(1 << 31))


def size_class(size: Column) -> Column:
    """Eight classes for each doubling, by the leading bits."""
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - 4, F.lit(0))
    return (bits * 8 + F.call_function("shiftright", size, shift) % 8).cast("int")


def turn(class_: Column) -> Column:
    """The place of a class: odd ones up, even ones down again."""
    return F.when(class_ % 2 == 1, class_).otherwise(1000 - class_)


def sized(documents: DataFrame, *, doc_id: str, source: str, text: str, seed: str, salts: int) -> DataFrame:
    """Documents with what decides their place in their source: __source, __size, __class, __salt, __tie, __hash."""
    tie = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("-"))).cast("binary"))
    out = documents.withColumns({"__size": size_of(text), "__source": F.col(f"`{source}`"), "__tie": tie, "__hash": F.xxhash64(F.col(f"`{text}`"))})
    return out.withColumns({"__class": size_class(F.col("__size")), "__salt": (F.conv(F.substring("__tie", 1, 6), 16, 10).cast("long") % salts).cast("int")})


def placed(rows: DataFrame, *, weights: tuple[int, ...], share: float, most: float, seed: str) -> DataFrame:
    """Sized documents with __source_size, __target and __copies."""
    with common.Scratch(rows.sparkSession, "mixing") as scratch:  # a row for each source, class and salt
        strata = scratch.keep(rows.groupBy("__source", "__class", "__salt").agg(F.count("*").alias("n"), F.sum("__size").alias("words")))
    totals = targets(strata.groupBy(F.col("__source").alias("source")).agg(F.sum("words").alias("source_size")), weights=weights, share=share, most=most)
    # strata: classes times salts for each source, whatever the number of documents
    order = Window.partitionBy("__source").orderBy(turn(F.col("__class")), "__salt").rowsBetween(Window.unboundedPreceding, -1)
    based = strata.withColumn("__base", F.coalesce(F.sum("n").over(order), F.lit(0)))
    based = based.join(totals, F.col("__source").eqNullSafe(totals["source"])).select(
        F.col("__source").alias("__s"), F.col("__class").alias("__c"), F.col("__salt").alias("__k"), "__base", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("__rate"),
        unit(F.concat(F.lit(f"{seed}:"), F.coalesce("__source", F.lit("")))).alias("__offset"),
    )
    within = Window.partitionBy("__source", "__class", "__salt").orderBy(F.col("__size").desc(), "__tie", "__hash")
    ranked = rows.withColumn("__rank", F.row_number().over(within))
    # null-safe throughout: a filter on keys that are not null would have sizes counted twice
    joined = ranked.join(based, F.col("__source").eqNullSafe(F.col("__s")) & F.col("__class").eqNullSafe(F.col("__c")) & F.col("__salt").eqNullSafe(F.col("__k")))
    rank = F.col("__base") + F.col("__rank")
    crossed = F.floor(F.col("__rate") * rank + F.col("__offset")) - F.floor(F.col("__rate") * (rank - 1) + F.col("__offset"))
    return joined.withColumn("__copies", crossed.cast("int"))


RESULTS = ("size", "source_size", "target", "copies")


@common.shielded
def mix(documents: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", salts: int = 64) -> DataFrame:
    """Documents with size, source_size, target and copies (how often the mix takes the row); columns of these names are replaced."""
    rows = placed(sized(documents, doc_id=doc_id, source=source, text=text, seed=seed, salts=salts), weights=weights, share=share, most=most, seed=seed)
    return rows.select(*common.columns(documents, but=RESULTS), *[F.col(f"__{c}").alias(c) for c in RESULTS])


@common.shielded
def mixed(documents: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", salts: int = 64) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of the documents, whatever their names."""
    rows = sized(documents, doc_id=doc_id, source=source, text=text, seed=seed, salts=salts)
    taken = placed(rows, weights=weights, share=share, most=most, seed=seed).filter("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*common.columns(documents))


def op7_mix(documents: DataFrame) -> DataFrame:
    """The contract's row for each document. Sizes are counted once; what follows needs no texts."""
    with common.Scratch(documents.sparkSession, "sizes") as scratch:
        rows = scratch.keep(sized(documents.select("doc_id", "source", "text"), doc_id="doc_id", source="source", text="text", seed="mix", salts=64).drop("text", "source"))
    out = placed(rows, weights=WEIGHTS, share=1.5, most=2.0, seed="mix")
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in RESULTS]).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS tie FROM documents),
c AS (SELECT *, length(bin(size)) * 8 + (size >> CAST(greatest(length(bin(size)) - 4, 0) AS BIGINT)) % 8 AS class, CAST('0x' || substr(tie, 1, 6) AS BIGINT) % 64 AS salt FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN class % 2 = 1 THEN class ELSE 1000 - class END, salt, size DESC, tie) AS rank FROM c),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM d GROUP BY source),
l AS (SELECT *, CAST([3, 1, 2][i % 3 + 1] AS BIGINT) AS w, 2.0::DOUBLE * source_size AS cap FROM t),
f AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0.0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
      FROM l WINDOW o AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, cap / w) AS level FROM f WHERE level < cap / w),
g AS (SELECT source, source_size, coalesce(least(cap, v.level * w), cap) AS target, (CAST('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8) AS BIGINT) & 2147483647) / 2147483648.0::DOUBLE AS u FROM f LEFT JOIN v ON true),
h AS (SELECT r.*, g.source_size, g.target, g.u, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate * rank + u) - floor(rate * (rank - 1) + u)) * size AS BIGINT) AS taken FROM h
"""
