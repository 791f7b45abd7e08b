"""Each stage of the pipeline on what its predecessor kept."""

import itertools

import corpus_pipeline
from arborix.llm import common, decontaminate, mixing, shinglelinks, simhash, tokenbin


def one_of_each(rows):
    """The least doc_id of each group that fingerprints within two bits or five-word shingles at 0.8 join, by all pairs."""
    label = {d: c for d, (_, c) in simhash.brute_force(rows).items()}
    sets = {d: set(shinglelinks.shingle_hashes((t or "").encode()).tolist()) for d, t in rows}
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if label[a] != label[b] and x and y and len(x & y) >= 0.8 * len(x | y):
            low, high = sorted((label[a], label[b]))
            label = {d: low if c == high else c for d, c in label.items()}
    return set(label.values())


def test_stages(spark, sf_dir):
    docs, at = common.table(spark, sf_dir, "documents"), {}
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        at[name] = (docs, out)
        if name != "token output":
            assert out.columns == first.columns
        docs = out.cache()
    before, kept = at["language ID"]
    assert kept.count() > 0.95 * before.count()
    before, kept = at["SimHash near-dedup"]
    assert {r.doc_id for r in kept.collect()} == one_of_each([(r.doc_id, r.text) for r in before.collect()])
    before, kept = at["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in common.table(spark, sf_dir, "benchmark").collect()]
    found = decontaminate.brute_force([(r.doc_id, r.text) for r in before.collect()], items)
    assert {r.doc_id for r in kept.collect()} == {d for d, v in found.items() if not v[-1]}
    before, kept = at["mixing"]
    assert kept.count() == sum(r.copies for r in mixing.mix(before).collect())
    before, kept = at["token output"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    assert kept.count() == len(rows)
    counts = {d: n for d, (_, n, _) in tokenbin.brute_force(rows).items()}
    assert all(r.n_tokens == counts[r.doc_id] for r in kept.collect())


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_empty_tables(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_awkward_rows_pass_all_stages(spark, sf_dir):
    rows = [(10 + k, f"plain words to learn from, number {n}", "en", "a", 1) for k, n in enumerate(("one", "two", "three", "four", "five", "six"))]
    rows += [(None, "a text without an id, of some words of its own", "en", "a", 1), (None, None, None, None, None), (1, None, "en", "a", 0), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "the same words in two rows", "en", "b", 5), (3, "the same words in two rows", "en", "b", 5), (4, "1 2 3", None, "b", 5)]
    docs = spark.createDataFrame(rows, common.table(spark, sf_dir, "documents").schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name == "SimHash near-dedup":  # no letter: no language; repeated rows are one
            left = [(r.doc_id, r.text) for r in docs.collect()]
            assert sorted(map(str, left)) == sorted(map(str, [*[r[:2] for r in rows[:7]], (3, rows[11][1])]))
    assert docs.count() >= 1
