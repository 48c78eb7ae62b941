"""Scores of rows that are repeated."""

import numpy as np
import pytest

from matlink.llm import hmm


def test_repeated_rows_count_once(spark):
    common = "the cat sat on the mat " * 20
    learned = [(i, f"{common} rare{i} odd{i % 5}") for i in range(30)]
    asked = [(1, learned[1][1])] * 4 + [(2, learned[2][1])] + [(None, f"{common} rare3 new words")] * 3 + [(None, None)] * 2
    train = spark.createDataFrame(learned, "doc_id long, text string")
    counts = hmm.count_words(train)
    model = hmm.train(train, counts, states=2, rounds=1, share=0.01)
    table = spark.createDataFrame(asked, "doc_id long, text string").repartition(3)
    rows = hmm.score(table, model, counts).collect()
    assert len(rows) == len(asked)
    every = [w for _, t in learned for w in [*t.split(), None]]
    for key in (1, 2, None):
        for text in {t for i, t in asked if i == key}:
            words = [*(text or "").split(), None]
            alone = hmm.score(spark.createDataFrame([(key, text)], "doc_id long, text string"), model, counts).first()
            base = sum(np.log10((every.count(w) + 1) / (len(every) + len(set(every)) + 1)) for w in words)
            own = [r for r in rows if r.doc_id == key and r.n_tokens == len(words)]
            assert len(own) == sum(a == (key, text) for a in asked)
            for r in own:
                assert r.n_known == sum(w in every for w in words)
                assert r.base_score == pytest.approx(base) and r.score == pytest.approx(alone.score)
