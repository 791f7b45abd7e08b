"""A search by batches that is stopped and started again."""

import pytest
from pyspark.sql import functions as F

from arborix.plans import progress, search
from arborix.plans.views import view
from arborix.sources import files


@pytest.fixture
def dealt(spark, tmp_path):
    rows = [(e, f"v{v:02}", f, (e * 7 + v * 3 + f) % 11 / 5.0) for e in range(3) for v in range(20) for f in range(4)]
    scores = spark.createDataFrame(rows, "em_id int, lm_vol string, frag_id int, s double")
    progress.deal_by_volume(scores, f"file://{tmp_path}/scores", 4)
    return scores, f"file://{tmp_path}"


def total(batch):
    return batch.groupBy("em_id", "lm_vol").agg(F.sum("s").alias("cov_score")).withColumn("variant", F.lit(0))


def rows_of(df):
    return sorted((r.em_id, r.lm_vol, r.variant, round(r.cov_score, 9)) for r in df.collect())


def test_a_volume_lies_in_one_file(spark, dealt):
    scores, base = dealt
    files_of = spark.read.parquet(f"{base}/scores").groupBy("lm_vol").agg(F.count_distinct(F.col("_metadata.file_name")).alias("n"))
    assert {r.n for r in files_of.collect()} == {1}
    progress.deal_by_volume(scores.limit(0), f"{base}/scores", 4)  # is there: stays
    assert spark.read.parquet(f"{base}/scores").count() == scores.count()


def test_the_second_run_scores_only_the_rest(spark, dealt):
    scores, base = dealt
    files_ = spark.read.parquet(f"{base}/scores").select(F.col("_metadata.file_name")).distinct().count()
    assert files_ > 3
    seen = []

    def stopped(batch):
        volumes = {r.lm_vol for r in batch.select("lm_vol").distinct().collect()}
        if len(seen) == 2:
            raise RuntimeError("the power is gone")
        seen.append(volumes)
        return total(batch)

    with pytest.raises(Exception, match="the power is gone"):
        progress.follow(spark, f"{base}/scores", f"{base}/out", stopped)
    first = set().union(*seen)
    assert len(seen) == 2 and {r.lm_vol for r in progress.entries(spark, f"{base}/out").collect()} == first
    # what the third batch had begun to write must not count
    half = spark.createDataFrame([(0, "half", -1.0, 0)], "em_id int, lm_vol string, cov_score double, variant int")
    half.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{base}/out/entries/batch=2")
    rest = []

    def going_on(batch):
        rest.append({r.lm_vol for r in batch.select("lm_vol").distinct().collect()})
        return total(batch)

    progress.follow(spark, f"{base}/scores", f"{base}/out", going_on)
    assert len(rest) == files_ - 2 and not first & set().union(*rest)
    assert rows_of(progress.entries(spark, f"{base}/out")) == rows_of(total(scores))
    progress.follow(spark, f"{base}/scores", f"{base}/out", going_on)
    assert len(rest) == files_ - 2  # nothing is left


def test_volumes_that_come_later(spark, dealt):
    scores, base = dealt
    progress.follow(spark, f"{base}/scores", f"{base}/out", total)
    later = scores.filter("lm_vol = 'v03'").withColumn("s", F.col("s") + 1).unionByName(scores.filter("lm_vol = 'v00'").withColumn("lm_vol", F.lit("new")))
    later.coalesce(1).write.mode("append").parquet(f"{base}/scores")
    seen = []
    progress.follow(spark, f"{base}/scores", f"{base}/out", lambda b: seen.append(b.count()) or total(b))
    assert seen == [24]
    want = total(scores.filter("lm_vol <> 'v03'").unionByName(later))
    assert rows_of(progress.entries(spark, f"{base}/out")) == rows_of(want)


def test_no_batch_is_finished(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        (tmp_path / "out" / "entries").mkdir(parents=True)
        progress.entries(spark, f"file://{tmp_path}/out")


def test_whole_search_by_batches(spark, sf_dir, tmp_path):
    """Entries by batches of volumes are those of all volumes at once."""
    em, frags, colors = (view(spark, sf_dir, n) for n in ("em_point", "frag_point", "frag_color"))
    frags = frags.withColumn("side", F.lit("normal"))
    sizes = frags.groupBy("side", "lm_vol", "frag_id").agg(F.count("*").alias("frag_points"))
    scores = sizes.join(em.select("em_id").distinct().filter("em_id < 3")).select("em_id", "side", "lm_vol", "frag_id", "frag_points", (F.lit(0.3) + F.pmod(F.col("frag_id") + F.col("em_id"), F.lit(7)) / 10).alias("score_full"), F.lit(0.2).alias("score_pruned"))
    scores = files.read_back(scores, "scores")
    options = search.SearchOptions(energy_threshold=-0.01, adaptive_factor=1.0, least_aggregate=0.01)
    colors = frags.select("lm_vol", "frag_id").distinct().withColumns({"r": F.col("frag_id") * 5 % 256.0, "g": F.lit(9.0), "b": F.col("lm_vol") * 20.0})
    out = f"file://{tmp_path}"
    progress.deal_by_volume(scores, f"{out}/scores", 3)
    progress.follow(spark, f"{out}/scores", out, lambda b: search.entries(b, em, frags.join(b.select("lm_vol").distinct(), "lm_vol", "left_semi"), colors, options))
    columns = ("em_id", "lm_vol", "variant", "frag_ids", "mirrored")
    of = lambda df: sorted((*(str(r[c]) for c in columns), round(r.cov_score, 9)) for r in df.collect())
    whole = of(search.entries(scores, em, frags, colors, options))
    assert of(progress.entries(spark, out)) == whole and any(w[-1] < 0 for w in whole)
