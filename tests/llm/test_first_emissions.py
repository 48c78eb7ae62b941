"""The first guess of Baum-Welch comes from all texts, in any order and of any length."""

import numpy as np
import pytest

from matlink.llm import hmm


def model_of(rows, parts):
    table = rows.repartition(parts) if parts > 1 else rows.coalesce(1)
    return hmm.train(table, hmm.count_words(table), states=4, rounds=2, share=0.001)


def test_short_texts_tell_states_apart(spark):
    halves = ["red blue green pink", "one two three four"]
    rows = spark.createDataFrame([(f"{halves[i % 2]} w{i % 7}",) for i in range(60)], "text string")
    emit = model_of(rows, 1).emit
    assert all(np.abs(emit[:, a] - emit[:, b]).max() > 0.01 for a in range(4) for b in range(a))
    assert np.allclose(emit.sum(axis=0), 1)


def test_order_of_texts_is_nothing(spark):
    hot = [("the same words of one source again and again " * 8,)] * 300
    rare = [(" ".join(f"x{i * j % 50}" for j in range(80)),) for i in range(40)]
    one = model_of(spark.createDataFrame(hot + rare, "text string"), 1)
    for rows, parts in ((rare + hot, 1), (hot + rare, 5)):
        got = model_of(spark.createDataFrame(rows, "text string"), parts)
        assert got.emit == pytest.approx(one.emit, abs=1e-9) and got.move == pytest.approx(one.move, abs=1e-9)


def test_equal_texts(spark):
    emit = model_of(spark.createDataFrame([("a b c",)] * 5 + [(None,)], "text string"), 2).emit
    assert np.isfinite(emit).all() and np.allclose(emit.sum(axis=0), 1)
