import random

import pytest

WORDS = "the of and river stone light über größe été maison niño año lamp seven 42 x1 don't Ünï A.B".split()


@pytest.fixture(scope="session", autouse=True)
def pii_key(spark):
    from arborix.llm import surrogates

    spark.conf.set(surrogates.KEY_SETTING, "key of the tests")


@pytest.fixture(scope="session")
def texts():
    """Documents of every awkward kind: null, empty, blank, short, very long, equal, nearly equal, sharing lines and passages."""
    rng = random.Random(11)
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage, line = words(160), "All rights reserved by the makers of this text."
    rows = [None, "", " ", "\n\n", "a", "  \t ", "one two", words(6000)]
    rows += [words(rng.randrange(1, 120)) for _ in range(20)]
    rows += [f"{words(30)}\n{line}\n{words(20)}" for _ in range(5)] + [f"  {line.upper()}\t\n{words(9)}"]
    rows += [words(40) + " " + passage + " " + words(30) for _ in range(4)] + [passage]
    base = words(400)
    rows += [base, base, base + " end", base.replace("river", "rivers", 1)]
    return list(enumerate(rows))


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The texts with extra columns, some named like the operators' own."""
    rows = [(i, t, ["en", "de", "fr", None][i % 4], [f"s{i % 5}", "s0", None][i % 3], len(t or ""), f"extra{i}", i) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size_note string, n int")


@pytest.fixture(scope="session")
def empty(spark, documents):
    return spark.createDataFrame([], documents.schema)


@pytest.fixture(scope="session")
def items(spark, texts):
    long = [t for _, t in texts if t and len(t.split()) > 60]
    rows = [(1, " ".join(long[0].split()[20:45])), (2, "one two"), (3, None), (4, ""), (5, "no such words anywhere here at all in these texts, truly none"), (10, " ".join(long[1].split()[3:20]).upper()), (2, "one two")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")
