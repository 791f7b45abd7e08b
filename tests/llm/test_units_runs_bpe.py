"""Fill-in-the-middle, periodic runs and BPE against brute force, on awkward and on very long texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborix.llm import bpe, infill, periodic

AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "has <P> in it"), (6, "only <M>"), (7, "<S>"), (8, "a < P > <p> <X>"), (9, "<<P"), (10, "x<S x>S> <"),
    (11, "né 日本語 🎉 é 　 x"), (12, "same text"), (12, "same text"), (13, "one two " * 400), (14, "word " * 30 + "other " * 30), (None, "no id at all"), (15, "a" * 65), (16, "b" * 64), (17, "\r\n\x0b\x0c x\x00y"),
    (18, "it's <|endoftext|> he'll  'twas\n\n  x <|endoftext|>"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    more = [(100 + k, "".join(random.Random(k).choice("ab <PSM> é\n") for _ in range(k % 150))) for k in range(300)]
    return [*AWKWARD, *more], spark.createDataFrame([*AWKWARD, *more], "doc_id long, text string")


def sorted_rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def brute(rows, function):
    return sorted(repr((d, *function(d, t))) for d, t in rows)


# ---- fill-in-the-middle


def test_infill_is_brute_force(awkward, documents, texts):
    rows, table = awkward
    assert sorted_rows(infill.op11_infill(table)) == brute(rows, infill.brute_force)
    assert sorted_rows(infill.op11_infill(documents)) == brute(texts, infill.brute_force)


def test_infill_of_a_very_long_text(spark):
    rows = [(21, "x" * 1_000_000), (22, "日 " * 300_000), (24, "\n" * 200_000)]
    assert sorted_rows(infill.op11_infill(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, infill.brute_force)


@pytest.mark.parametrize("unit", ["word", "line", r"\d+"])
def test_infill_by_other_units(spark, unit):
    import re

    texts = [f"line {k}\nand 12 345 more  of\n\nthem {k} " * (k % 90) for k in range(200)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in infill.infill(table, unit=unit, plain_percent=0, block=8).collect():
        text = texts[r.doc_id]
        units = [m[0] for m in re.finditer(f"(?:{infill.UNITS.get(unit, unit)})|(?s:.)", text)]
        assert "".join(units) == text and r.n_units == len(units)
        if not text:
            assert r.form == "plain"
            continue
        edges = {sum(map(len, units[:k])) for k in range(len(units) + 1)}
        a, b = r.prefix_chars, r.prefix_chars + r.middle_chars
        assert {a, b} <= edges
        pre, mid, suf = text[:a], text[a:b], text[b:]
        assert r.output == (f"<P>{pre}<S>{suf}<M>{mid}" if r.form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}")


def test_infill_keeps_columns_and_restores(documents, empty):
    out = infill.infill(documents.withColumn("form", F.lit("old")))
    assert [c for c in out.columns if c not in infill.RESULTS] == documents.columns and set(r.form for r in out.collect()) <= {"plain", "psm", "spm"}
    assert out.filter(infill.restored(F.col("output"), F.col("form")) != F.coalesce("text", F.lit(""))).isEmpty()
    assert out.filter("text IS NULL").count() == documents.filter("text IS NULL").count()
    assert infill.op11_infill(empty).count() == 0
    hidden = infill.infill(documents.withColumn("__row", F.lit("kept")))
    assert {r["__row"] for r in hidden.collect()} == {"kept"}


def test_infill_deals_texts_once(spark, sf_dir):
    out = infill.op11_infill(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out.write.format("noop").mode("overwrite").save()
    rows = out.groupBy().agg(*[F.max(c) for c in out.columns])
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan and "Cartesian" not in plan and "Python" not in plan


# ---- periodic runs


def test_runs_are_brute_force(awkward, documents, texts):
    rows, table = awkward
    assert sorted_rows(periodic.op12_periodic(table)) == brute(rows, periodic.brute_force)
    short = [(d, t) for d, t in texts if len((t or "").split()) < 1000]
    got = periodic.op12_periodic(documents.filter(F.col("doc_id").isin([d for d, _ in short])))
    assert sorted_rows(got) == brute(short, periodic.brute_force)


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(4000):
        words = [str(rng.randrange(rng.choice([1, 2, 2, 3, 8]))).encode() for _ in range(rng.randrange(70))]
        for _ in range(rng.randrange(3)):
            if words:
                a, q, m = rng.randrange(len(words)), rng.randrange(1, 7), rng.randrange(4, 30)
                words[a:a] = (words[a : a + q] * m)[:m]
        assert [tuple(map(int, r)) for r in periodic.find_runs(periodic.numbers(words))] == periodic.brute_runs(words), words


def test_runs_of_very_long_texts():
    same = np.zeros(300_000, np.int32)
    assert periodic.find_runs(same).tolist() == [[0, 300_000, 1]]
    block = np.random.default_rng(1).integers(0, 3000, 60_000).astype(np.int32)
    assert periodic.find_runs(np.tile(block, 5)).tolist() == [[0, 300_000, 60_000]]
    pairs = np.tile(np.repeat(np.array([0, 1], np.int32), 6), 10_000)
    assert len(periodic.find_runs(pairs)) == 20_001


def test_collapse(spark, documents, empty):
    rows = [(1, "so  " + "ha " * 9 + "end"), (2, "nothing\there"), (3, None), (4, "a b " * 5 + "c d " * 5)]
    got = {r.doc_id: r.text for r in periodic.collapse(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "so ha end", 2: "nothing\there", 3: None, 4: "a b c d"}
    assert periodic.collapse(documents).columns == documents.columns
    assert set(periodic.with_runs(documents.withColumn("runs", F.lit(1))).columns) == {*documents.columns, "n_words", "runs", "collapsed"}
    assert periodic.op12_periodic(empty).count() == 0
    with pytest.raises(ValueError):
        periodic.with_runs(documents, min_periods=3)


# ---- BPE


def test_bpe_is_the_library(awkward, documents, texts, empty):
    rows, table = awkward
    assert sorted_rows(bpe.op13_bpe(table)) == brute(rows, lambda _, t: bpe.brute_force(t))
    assert sorted_rows(bpe.op13_bpe(documents)) == brute(texts, lambda _, t: bpe.brute_force(t))
    assert bpe.op13_bpe(empty).count() == 0


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.vocabulary_path())


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text.encode()), codec.dtype).tolist()


def test_bpe_of_random_texts(codec):
    rng = random.Random(3)
    pools = ["ab c'sdt ", "  \n\t  　 x'", "'ll 've 're % .' 12 34", "日本語中文 。、", "🎉é ñ́ ßÜ​﻿\x1c\x85", "".join(map(chr, range(1, 0x2FF))), "{}[]()'\"''.,;:!?%&$#@ \n a1"]
    for k in range(30_000):
        pool = pools[k % (len(pools) + 1)] if k % (len(pools) + 1) < len(pools) else "".join(pools)
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))
        if k % 20 == 0:
            text = text[:3] + "<|endoftext|>" + text[3:]
        want = codec.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids_of(codec, text) == want, text
        assert codec.decode(want).decode() == codec.tokenizer.decode(want, skip_special_tokens=False)
        if k % 50 == 0:  # ids that no text has: broken characters, unknown ids
            some = [rng.randrange(50_300) for _ in range(8)]
            assert codec.decode(some).decode() == codec.tokenizer.decode(some, skip_special_tokens=False)


def test_bpe_at_every_character(codec):
    for point in [*range(1, 0x3000), *range(0x3000, 0xD800, 7), *range(0xE000, 0x30000, 41), *map(ord, bpe.BLANKS)]:
        text = f"a{chr(point)}b {chr(point)}  {chr(point)}{chr(point)}'s"
        assert ids_of(codec, text) == codec.tokenizer.encode(text, add_special_tokens=False).ids, hex(point)


def test_bpe_cuts_are_in_no_token(codec):
    added = codec.tokenizer.get_added_tokens_decoder()
    for i, token in codec.tokens.items():
        assert i in added or not any(codec.cut[a << 8 | b] for a, b in zip(token, token[1:]))  # noqa: B905
    assert codec.cut[ord("a") << 8 | ord(" ")] and len(codec.fragments(b"cut before each blank")) == 4


def test_bpe_of_very_long_words(codec):
    for text in ("a" * 1_000_000, "日本語" * 100_000, " " * 1_000_000, "'" * 300_000):
        assert ids_of(codec, text) == codec.tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_memory_is_bounded(monkeypatch, codec):
    monkeypatch.setattr(bpe, "GENERATION", 100)
    small = bpe.Codec(bpe.vocabulary_path())
    rng = random.Random(2)
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcdefghé日") for _ in range(rng.choice([5, 9, 200]))) for _ in range(9))
        assert ids_of(small, text) == ids_of(codec, text)
        assert len(small) <= 100 and len(small.old) <= 100 and all(len(k) <= bpe.REMEMBER for k in small)


def test_bpe_columns(spark, documents):
    out = bpe.decoded(bpe.encoded(documents.withColumn("ids", F.lit(1))))
    assert set(out.columns) == {*documents.columns, "ids", "decoded"} and out.filter("decoded <> coalesce(text, '')").isEmpty()
    assert bpe.decoded(spark.createDataFrame([(None,)], "ids array<int>")).first().decoded is None
