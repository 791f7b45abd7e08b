"""Merging of nested documents against dictionaries merged one after the other."""

import json
import random

import pytest

from arborix.sources import documents


def merged(a, b):
    """As nested dictionaries are merged: objects into one another, lists joined, else the later one."""
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merged(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in [*a, *(k for k in b if k not in a)]}
    return a + b if isinstance(a, list) and isinstance(b, list) else b


def leaves(tree, path=()):
    if isinstance(tree, dict) and tree:
        return {p: v for k, sub in tree.items() for p, v in leaves(sub, (*path, k)).items()}
    return {path: tree}


def folded(docs):
    out = docs[0]
    for d in docs[1:]:
        out = merged(out, d)
    return leaves(out)


def run(spark, docs):
    table = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "file int, value string")
    return {tuple(r.path): json.loads(r.value) for r in documents.deep_merge(table.repartition(3)).collect()}


def random_document(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.25:
        return rng.choice([1, 2.5, "text", None, True, [1], [2, [3]], [], {}, [{"a": 1}]])
    return {rng.choice("abc"): random_document(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_random_documents(spark):
    rng = random.Random(6)
    for _ in range(6):
        docs = [{k: random_document(rng, 3) for k in rng.sample("abcd", 3)} for _ in range(6)]
        assert run(spark, docs) == folded(docs), docs


def test_kinds_that_meet(spark):
    docs = [{"a": {"x": 1}, "l": [1], "s": [1], "o": 5, "d": {"p": {"q": {"r": 1}}}}, {"a": 3, "l": [2, 3], "s": 2, "o": {"y": 1}, "d": {"p": {"q": {"r": 2, "t": []}}}}, {"a": {"z": 2}, "l": [[4]], "s": [3], "o": {}, "e": {}}]
    assert run(spark, docs) == folded(docs)
    assert run(spark, docs)[("a", "z")] == 2 and ("a", "x") not in run(spark, docs) and run(spark, docs)[("s",)] == [3]


def test_broken_and_empty(spark):
    table = spark.createDataFrame([(0, None), (1, "{broken"), (2, '{"a": 1}')], "file int, value string")
    assert [tuple(r) for r in documents.deep_merge(table).collect()] == [(["a"], "1")]
    assert documents.deep_merge(table.filter("file < 1")).count() == 0


def test_score_files(spark):
    docs = [{"7": {"R1_1": [0.5, -0.25], "R1_2": [1.0, 2.0]}}, {"7": {"R2_1": [0.125, 0.0]}, "8": {"R1_1": [0.75, 0.5]}}, {"8": {"R1_1": [3.0]}}]
    table = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "file int, value string")
    got = {(r.em, r.name): r.scores for r in documents.merged_scores(table).collect()}
    assert got == {("7", "R1_1"): [0.5, -0.25], ("7", "R1_2"): [1.0, 2.0], ("7", "R2_1"): [0.125, 0.0], ("8", "R1_1"): [0.75, 0.5, 3.0]}


@pytest.mark.parametrize("small", [0, 20, 1 << 14])
def test_leaves_that_meet_members_at_many_depths(spark, monkeypatch, small):
    """What is a leaf here and has members there, above and below what others overruled, in texts on both sides of ``SMALL``."""
    monkeypatch.setattr(documents, "SMALL", small)
    rng = random.Random(16 + small)
    docs = [{k: random_document(rng, 6) for k in rng.sample("ab", 2)} for _ in range(9)]
    assert run(spark, docs) == folded(docs), docs
    docs = [{"a": {"b": {"c": 1}}}, {"a": {"b": {"c": {"d": 1}}}}, {"a": 5}, {"a": {"b": {"c": {}}}}, {"a": {"b": {"n": None}}}]
    assert run(spark, docs) == folded(docs) == {("a", "b", "c"): {}, ("a", "b", "n"): None}


def test_names_and_texts_that_look_like_json(spark):
    docs = [{"a.b": {"": {"$": "[1]"}}, "t": "{\"x\": 1}", "q": "\"", "l": ["[", {"k": []}], "n": None}, {"l": [], "a.b": {"": {"x,y": "{}"}}}, {"l": [None, "],["]}]
    assert run(spark, docs) == folded(docs)


def test_documents_of_one_shape_are_written_once(spark, monkeypatch):
    """Score documents are opened in one pass: neither a table for each level nor a search for leaves that meet members."""
    labels, written = [], documents.read_back
    monkeypatch.setattr(documents, "read_back", lambda table, label: labels.append(label) or written(table, label))
    docs = [{"7": {"1": {"5": {"score": 0.5}}}}, {"7": {"1": {"5": {"score": 0.25}, "6": {"score": 1.0}}}}]
    assert run(spark, docs) == folded(docs) and labels == ["leaves"]
