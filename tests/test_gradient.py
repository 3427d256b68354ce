"""Softmax regression by distributed sums against plain numpy, and the MLlib
head's persistence."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from claimspark.operators import gradient as GR
from claimspark.operators import mlheads as ML
from claimspark.operators import tanh_net as TN


def numpy_fit(x, y, rounds, l2):
    """Accelerated gradient steps; the last column is the bias."""
    w = p = np.zeros((x.shape[1], 3))
    rate = 2 / (x ** 2).sum(axis=1).max()
    for r in range(rounds):
        z = x @ p
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = x.T @ (e / e.sum(axis=1, keepdims=True) - np.eye(3)[y]) / len(x)
        g[:-1] += l2 * p[:-1]
        new = p - rate * g
        p, w = new + (r + 1) / (r + 4) * (new - w), new
    return w


def test_weights_equal_plain_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((80, 6)) < 0.5, rng.normal(0, 1, (80, 6)), 0.0)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.3)
    rows = [(i, str(j), float(x[i, j])) for i in range(80) for j in range(6) if x[i, j]]
    ids = spark.createDataFrame([(i,) for i in range(80)], "id long")
    feats = GR.with_bias(spark.createDataFrame(rows, "id long, key string, x double"), ids)
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(60)], "id long, label long")
    got = {r.key: (r.w0, r.w1, r.w2) for r in GR.fit_softmax(feats, labels, rounds=25, l2=0.01).collect()}
    full = np.c_[x, np.ones(80)]
    want = numpy_fit(full[:60], y[:60], 25, 0.01)
    assert np.allclose([got[str(j)] for j in range(6)] + [got[""]], want)
    table = spark.createDataFrame([(k, *v) for k, v in got.items()], "key string, w0 double, w1 double, w2 double")
    scored = {r.id: r for r in GR.predict(feats, table).collect()}
    z = full @ want
    assert [scored[i].prediction for i in range(80)] == list(z.argmax(axis=1))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose([scored[i].probability for i in range(80)], p.max(axis=1))


def test_bow_features_have_length_one_and_skip_unknown_terms(spark):
    data = spark.createDataFrame([(1, "a cat sat", "a cat"), (2, "the cat sat", "dog"), (3, None, "")],
                                 "id long, sentence1 string, sentence2 string")
    vocabulary = ML.bow_vocabulary(data)
    got = {(r.id, r.key): r.x for r in GR.bow_features(data, vocabulary, id_col="id").collect()}
    assert set(got) == {(i, k) for i in (1, 2) for k in ("sentence1|cat", "sentence1|sat", "sentence1|cat sat")} \
        | {(1, ""), (2, ""), (3, "")}
    assert abs(sum(x * x for (i, k), x in got.items() if i == 1 and k) - 1) < 1e-12


def test_mllib_head_keeps_its_predictions_when_saved(spark, tmp_path):
    rows = [(f"good thing {i}", f"yes {i % 3}", 0) for i in range(12)] + [(f"bad thing {i}", f"no {i % 3}", 1) for i in range(12)] \
        + [(f"odd é {i}", "maybe", 2) for i in range(12)]
    train = spark.createDataFrame(rows, "sentence1 string, sentence2 string, label long")
    model = ML.fit_bow_logistic(train, max_iter=20)
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))  # the cleaning is part of it
    again = loaded.transform(train).select("label", "prediction").collect()
    judged = ML.judge_stance(train, loaded).collect()
    assert [r.label_id for r in judged] == [int(r.prediction) for r in again] and all(1 / 3 < r.confidence <= 1 for r in judged)
    assert [tuple(r) for r in again] == [tuple(r) for r in model.transform(train).select("label", "prediction").collect()]
    assert sum(r.label == r.prediction for r in again) == len(rows)


# --- hidden tanh layers -----------------------------------------------------

def net_data(spark, n=300):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (n, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 0.8)
    return x, y, spark.createDataFrame([(f"e{i}", x[i].tolist(), int(y[i])) for i in range(n)],
                                       "id string, features array<double>, label long")


def test_tanh_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    x, y, sizes = rng.normal(0, 1, (9, 4)), rng.integers(0, 3, 9), [4, 5, 5, 5, 3]
    values = TN.flat(TN.first_layers(sizes, 1))
    _, grad = TN.loss_gradient(x, y, TN.unflat(values, sizes))
    for at in rng.integers(0, len(values), 25):
        up, down = values.copy(), values.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        slope = (TN.loss_gradient(x, y, TN.unflat(up, sizes))[0] - TN.loss_gradient(x, y, TN.unflat(down, sizes))[0]) / 2e-5
        assert abs(slope - grad[at]) < 1e-5


def test_tanh_net_learns_and_does_not_depend_on_the_dealing(spark, monkeypatch):
    monkeypatch.setattr(TN, "ROWS_PER_PART", 12)  # 25 parts: two levels of merging
    x, y, df = net_data(spark)
    args = dict(id_col="id", hidden=(12, 12, 12), rounds=25, rate=0.03)
    layers = TN.fit(df, **args)
    again = TN.fit(df.repartition(7), **args)
    assert all((a == b).all() for p, q in zip(layers, again) for a, b in zip(p, q))
    # the same steps on the whole table at once
    sizes = [4, 12, 12, 12, 3]
    values = TN.flat(TN.first_layers(sizes, 42))
    m = v = np.zeros_like(values)
    for step in range(1, 26):
        g = TN.loss_gradient(x, y, TN.unflat(values, sizes))[1] / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        values = values - 0.03 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    assert np.allclose(TN.flat(layers), values, atol=1e-6)
    z = [r.z for r in df.orderBy(F.substring("id", 2, 9).cast("int")).select(TN.logits_column(spark, F.col("features"), layers).alias("z")).collect()]
    assert np.allclose(z, TN.forward(x, layers)[-1]) and (np.argmax(z, axis=1) == y).mean() > 0.8
