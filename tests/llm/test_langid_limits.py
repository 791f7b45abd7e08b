"""Rejection is calibrated on all labelled texts of a language, however many there are."""

import numpy as np

from arborix.llm import langid


def test_limits_of_all_texts(spark):
    texts = [f"word{chr(97 + k % 26)} {chr(97 + k // 26 % 26)}{chr(97 + k // 676)}x and more" for k in range(2200)]
    df = spark.createDataFrame([(t, "en") for t in texts + texts[:50]], "text string, lang string")
    model = langid.train(df)
    bits = np.array([r["__p"].bits for r in model.score(df.distinct()).collect()])
    mean, limit = model.limits["en"]
    assert abs(mean - bits.mean()) < 1e-9 and abs(limit - langid.REJECT * max(bits.std(), 0.05)) < 1e-9
