"""The blocked multinomial fit against Spark ML's and against plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inplay.operators import models as md, softmax


def frame(spark, n=600):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(3, 2, n), rng.integers(0, 2, n), np.full(n, 0.25), rng.exponential(40, n)])
    z = np.column_stack([0 * x[:, 0], x[:, 0] - 3, 2 * x[:, 1] - 1, np.full(n, -9.0), x[:, 3] / 40 - 1])  # the fourth class is almost never seen
    y = (z + rng.gumbel(size=z.shape)).argmax(1)
    return spark.createDataFrame([([float(v) for v in r], int(k), 0.5 + (i % 3)) for i, (r, k) in enumerate(zip(x, y))], "x array<double>, label int, w double")


def losses(rows, p):
    return sum(-r.w * np.log(q[r.label]) for r, q in zip(rows, p)) / sum(r.w for r in rows)


def test_fit_is_as_good_as_spark_mls(spark, monkeypatch):
    df = frame(spark)
    rows = df.collect()
    monkeypatch.setattr(softmax, "PIECE", 50)
    monkeypatch.setattr(softmax, "BLOCK", 16)
    model = softmax.fit(df)
    x = np.array([r.x for r in rows])
    from pyspark.ml.functions import array_to_vector, vector_to_array

    other = md.fit_outcomes(df).transform(df.select(array_to_vector("x").alias("features"))).select(vector_to_array("probability").alias("p")).collect()
    p, q = model.probabilities(x), np.array([r.p for r in other])
    assert p.sum(1) == pytest.approx(1) and losses(rows, p) == pytest.approx(losses(rows, q), abs=1e-4) and np.abs(p - q).max() < 0.02
    scored = df.select("label", "x", softmax.probability(model, F.col("x"), F.col("label")).alias("p")).collect()
    assert [r.p for r in scored] == pytest.approx([model.probabilities(np.array([r.x]))[0, r.label] for r in scored])


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    piece = softmax.Piece(rng.normal(size=(300, 3)).astype(np.float32), rng.integers(0, 4, 300), rng.random(300))
    b = rng.normal(size=(4, 4)) / 5
    at = lambda b: piece.loss(softmax.Softmax(np.array([0.1, 0, -0.2]), np.array([1, 2, 0.5]), b[1:], b[0]))
    g = at(b)[1:].reshape(4, 4)
    for i, j in ((0, 1), (1, 2), (3, 0)):
        step = np.zeros((4, 4))
        step[i, j] = 0.05
        assert (at(b + step)[0] - at(b - step)[0]) / 0.1 == pytest.approx(g[i, j], rel=2e-2, abs=2e-2)


def test_missing_features_are_an_error(spark):
    with pytest.raises(ValueError, match="missing"):
        softmax.fit(spark.createDataFrame([([1.0, float("nan")], 0, 1.0), ([2.0, 1.0], 1, 1.0)], "x array<double>, label int, w double"))
