"""JSON documents of any nesting, merged as nested dictionaries are.

Documents are opened down to their leaves where they lie, some levels in one
pass, and the leaves meet in one aggregate by path. What a later document says
of a path that is no object takes the place of all that earlier ones had there
and below; of lists the last run is put together, in order. Where the same path
is a leaf in some documents and an object with members in others is looked for
only at depths that have both, and no document meets another whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import read_back

#: Levels that a pass opens before what it found is written, leaves of a task that merges, and bytes of a text whose members share its names.
LEVELS, LEAVES, SMALL = 4, 500_000, 1 << 14


def open_level(rows: DataFrame) -> DataFrame:
    """(f, path, v, size) with objects replaced by their members; what is no object, or an empty one, stays.

    A member of a VARIANT carries all names of the text it was parsed from, of which ``size`` is the length. Of a large text each
    member is parsed by itself, so that what is carried grows with the text, not with its square.
    """
    large, text, members = F.col("size") > SMALL, F.to_json("v"), "map<string,variant>"
    opened = F.when(large, F.when(text.startswith("{"), F.from_json(text, members, {"mode": "FAILFAST"}))).otherwise(F.try_variant_get("v", F.lit("$"), members))
    each = rows.select("f", "path", "v", "size", F.explode_outer(opened).alias("key", "member"))
    here = F.col("key").isNull()
    path, member = F.when(here, F.col("path")).otherwise(F.concat("path", F.array("key"))), F.coalesce("member", F.parse_json(F.lit("null")))
    size = F.when(here, F.lit(0)).when(large, F.length(F.to_json(member))).otherwise(F.col("size"))
    return each.select("f", path.alias("path"), F.when(here, F.col("v")).otherwise(member).alias("v"), size.alias("size"))


def document_leaves(documents: DataFrame, order: str, column: str) -> DataFrame:
    """(f, path, depth, kind, text) of the leaves of each document; kind: scalar, list or object (an empty one)."""
    rows, parts = documents.select(F.col(order).alias("f"), F.array().cast("array<string>").alias("path"), F.col(column).alias("text")), []
    text = F.col("text")
    kind = F.when(text.startswith("["), "list").when(~text.startswith("{"), "scalar").when(text == "{}", "object").otherwise("open")
    while True:
        rows = rows.select("f", "path", F.try_parse_json("text").alias("v"), F.length("text").alias("size")).filter("v IS NOT NULL")
        for _ in range(LEVELS):
            rows = open_level(rows)
        rows = rows.select("f", "path", F.to_json("v").alias("text"))
        found = read_back(rows.select("f", "path", F.size("path").alias("depth"), kind.alias("kind"), "text"), "leaves")
        parts.append(found.filter("kind <> 'open'"))
        rows = found.filter("kind = 'open'").select("f", "path", "text")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, parts)


def overruled(leaves: DataFrame) -> DataFrame:
    """The leaves that no later document overrules above them, with ``deep``: the last document that has members at the path."""
    no = F.lit(None).cast(leaves.schema["f"].dataType)
    marked = leaves.withColumn("cut", no).withColumn("deep", no)
    depths = sorted(r.depth for r in leaves.select("depth").distinct().collect())  # as many as there are levels
    for d in depths[:-1]:
        own = leaves.filter(F.col("depth") == d).groupBy("path").agg(F.max(F.when(F.col("kind") != "object", F.col("f"))).alias("last"))
        below = leaves.filter(F.col("depth") > d).groupBy(F.slice("path", 1, d).alias("path")).agg(F.max("f").alias("members"))
        meet = read_back(own.join(below, "path").withColumnRenamed("path", "at"), "meet")
        if meet.isEmpty():
            continue
        reached = marked.filter(F.col("depth") >= d).withColumn("at", F.slice("path", 1, d)).join(meet, "at", "left")
        reached = reached.withColumn("cut", F.greatest("cut", F.when(F.col("depth") > d, F.col("last")))).withColumn("deep", F.when(F.col("depth") == d, F.col("members")).otherwise(F.col("deep")))
        marked = marked.filter(F.col("depth") < d).unionByName(reached.select(*marked.columns))
    kept = marked.filter(F.col("cut").isNull() | (F.col("f") > F.col("cut")))
    return kept.withColumn("deep", F.when(F.col("cut").isNull() | (F.col("deep") > F.col("cut")), F.col("deep")))


def deep_merge(documents: DataFrame, order: str = "file", column: str = "value") -> DataFrame:
    """(path: array of keys, value: JSON text) of every leaf of the merged document, from documents (order, column).

    A leaf is a scalar, a list or an empty object; of scalars the later one counts, lists join, and where an object meets
    anything else the later one counts. Documents of the same order must not hold the same leaves. Null and broken documents are left out.
    """
    leaves = document_leaves(documents, order, column)
    tasks = max(documents.sparkSession.sparkContext.defaultParallelism, leaves.count() // LEAVES)
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    pair = F.struct("f", "text")
    by_path = overruled(leaves).repartition(tasks, "path").groupBy("path").agg(
        F.max(of("scalar", pair)).alias("scalar"), F.max(of("object", F.col("f"))).alias("empty"), F.max("deep").alias("deep"), F.collect_list(of("list", pair)).alias("lists"),
    )
    last_object, last_list = F.greatest("empty", "deep"), F.array_max("lists")["f"]
    ends = by_path.withColumn("leaf", F.greatest("scalar.f", last_list)).withColumn("object", last_object).withColumn("broken", F.greatest("scalar.f", last_object))
    run = F.transform(F.array_sort(F.filter("lists", lambda r: F.col("broken").isNull() | (r["f"] > F.col("broken")))), lambda r: F.substring(r["text"], F.lit(2), F.length(r["text"]) - 2))
    joined = F.concat(F.lit("["), F.array_join(F.filter(run, lambda items: items != ""), ","), F.lit("]"))
    no_members = F.col("deep").isNull() | (F.col("deep") <= F.col("leaf"))
    object_last = F.col("object").isNotNull() & (F.col("leaf").isNull() | (F.col("object") > F.col("leaf")))
    value = F.when(object_last, F.when(no_members, F.lit("{}"))).when(F.col("scalar.f") == F.col("leaf"), F.col("scalar.text")).when(F.size(run) > 0, joined)
    return ends.select("path", value.alias("value")).filter("value IS NOT NULL")


def merged_scores(documents: DataFrame, order: str = "file", column: str = "value") -> DataFrame:
    """(em, name, scores) of score documents, as the files of a folder, merged in order, have them: lists of a key that is in
    several files are joined."""
    leaves = deep_merge(documents, order, column).filter(F.size("path") == 2)
    return leaves.select(F.col("path")[0].alias("em"), F.col("path")[1].alias("name"), F.from_json("value", "array<double>").alias("scores"))
