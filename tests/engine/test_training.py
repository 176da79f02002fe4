"""Networks, training rounds, the model store and row numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import models, training
from tidewake.operators.kernels.network import Perceptron, SpeedNet
from tidewake.operators.numbering import numbered
from tidewake.shared import new_path
from tidewake.sources import store as stores
from tidewake.sources.store import Store


@pytest.mark.parametrize("net, shape", [(SpeedNet(3, 5, 0.2, 1.5, 4.0), (4, 7, 3)), (Perceptron((4, 6, 6, 2), 0.1, 2.0, np.array([2.0, 3.0])), (5, 4))])
def test_gradients_match_finite_differences(net, shape):
    rng = np.random.default_rng(1)
    theta, x = net.start(3) + rng.normal(0, 0.05, net.size), rng.normal(size=shape)
    out, kept = net.forward(theta, x)
    weight = rng.normal(size=out.shape)
    got = net.backward(theta, kept, weight)
    for k in rng.choice(net.size, min(net.size, 120), replace=False):
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        want = ((net.forward(up, x)[0] - net.forward(down, x)[0]) * weight).sum() / 2e-5
        assert got[k] == pytest.approx(want, rel=1e-4, abs=1e-6)


def examples(spark, n=1500):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 2, 6))
    y = np.maximum(3 + 3 * (x[:, 0] * (1, -1, 1, -1, 1, -1)).mean(1), 0)  # the order matters, which a window's moments do not show
    return spark.createDataFrame([(i, w.tolist(), float(v)) for i, (w, v) in enumerate(zip(x, y, strict=True))], "key long, window array<array<double>>, target double")


@pytest.fixture(scope="module")
def parts(spark):
    rows = examples(spark)
    cut = lambda cond, k: training.blocks(rows.where(cond).repartition(k), ["key"], "window", "target", rows=100, batch=4)
    return cut("key % 5 > 0", 3), cut("key % 5 = 0", 2), rows


SCHEDULE = training.Schedule(epochs=15, rate=0.02, batch=4)
NET = SpeedNet(2, 8, level=3.0)


def alone(net, table, validation, s):
    """The same schedule in one process."""
    rows, held = table.orderBy("block").collect(), validation.collect()
    theta, step, best, least = net.start(s.seed), training.AdamW(net.size, s.decay, s.clip), None, np.inf
    for epoch in range(s.epochs):
        for k in sorted({r["batch"] for r in rows}):
            own = [training.arrays(r) for r in rows if r["batch"] == k]
            g = sum(training.block_gradient(net, theta, x, y, s)[0] for x, y in own)
            theta = step.update(theta, g * training.UNIT / sum(len(x) for x, _ in own), s.rate_at(epoch))
        loss = np.mean(np.concatenate([training.huber(net.forward(theta, x)[0] - y, s.delta)[0].ravel() for x, y in map(training.arrays, held)]))
        if loss < least:
            best, least = theta, loss
    return best, least


def test_training_beats_the_ridge_and_equals_one_process(spark, parts):
    train, val, rows = parts
    got = training.train(NET, train, val, SCHEDULE)
    theta, loss = alone(NET, train, val, SCHEDULE)
    assert np.abs(got.theta - theta).max() < 1e-6
    assert min(h["val_loss"] for h in got.history) == pytest.approx(loss, abs=1e-5)
    ridge = models.Linear.fit_all(rows.where("key % 5 > 0"), "window", "target")
    held = rows.where("key % 5 = 0")
    error = lambda m: models.infer(held, "window", m).agg(F.avg(F.abs(F.col("prediction")[0] - F.col("target")))).first()[0]
    assert error(got) < 0.8 * error(ridge)


def test_weights_do_not_follow_the_layout(spark, parts):
    train, val, _ = parts
    short = training.Schedule(epochs=2, rate=0.02, batch=4)
    one, many = (training.train(NET, train.repartition(k), val.repartition(k), short) for k in (1, 7))
    assert (one.theta == many.theta).all() and [h["val_loss"] for h in one.history] == [h["val_loss"] for h in many.history]


def test_blocks_do_not_follow_the_input_order(spark, parts):
    train, _, rows = parts
    again = training.blocks(rows.where("key % 5 > 0").orderBy(F.desc("key")), ["key"], "window", "target", rows=100, batch=4)
    key = lambda t: sorted((r["block"], r["batch"], r["n"], bytes(r["x"]), bytes(r["y"])) for r in t.collect())
    assert key(again) == key(train) and {r["n"] for r in train.collect()} == {100}


def test_rounds_are_bounded_and_keep_every_example(spark, parts):
    """a larger table has larger batches, not more rounds."""
    rows = parts[2]
    few = training.blocks(rows, ["key"], "window", "target", rows=10, batch=4, rounds=5).collect()
    assert len({r["batch"] for r in few}) == 5 and sum(r["n"] for r in few) == 1500 and max(r["block"] for r in few) == 149
    many = training.blocks(rows, ["key"], "window", "target", rows=10, batch=4, rounds=100).collect()
    assert {r["block"]: r["batch"] for r in many} == {k: k // 4 for k in range(150)}


def test_training_without_rows(spark, parts):
    train, val, _ = parts
    none = train.limit(0)
    assert (training.train(NET, none, val, SCHEDULE).theta == NET.start(42)).all()
    short = training.train(NET, train, none, training.Schedule(epochs=1, batch=4))
    assert short.history[0]["best"] and (short.theta != NET.start(42)).any()


def test_examples_that_are_not_finite_are_left_out(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0], 1.0), (1, [float("nan"), 2.0], 1.0), (2, [1.0, 2.0], float("inf"))], "key long, x array<double>, y double")
    (block,) = training.blocks(rows, ["key"], "x", "y").collect()
    assert block["n"] == 1 and training.arrays(block)[0].tolist() == [[1.0, 2.0]]


def test_store_versions_digests_and_broken_writes(spark, monkeypatch):
    store = Store(spark, new_path(spark, "models"))
    assert store.versions("a") == []
    weights = np.arange(6.0).reshape(2, 3)
    assert [store.save("a", {"w": weights * k}, {"k": k}) for k in (1, 2)] == [1, 2]
    got, facts = store.load("a")
    assert (got["w"] == weights * 2).all() and facts == {"k": 2} and (store.load("a", 1)[0]["w"] == weights).all()

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, *_):
            raise OSError("lost")

    monkeypatch.setattr(store, "_fs", Broken(store._fs))
    with pytest.raises(OSError):
        store.save("a", {"w": weights})
    monkeypatch.undo()
    assert store.versions("a") == [1, 2] and store.load("a")[1] == {"k": 2}
    assert sorted((r["name"], r["version"], r["intact"]) for r in store.registry().collect()) == [("a", 1, True), ("a", 2, True)]


def test_an_altered_file_is_refused():
    content = stores.packed({"w": np.ones(3)})
    assert (stores.unpacked(content)[0]["w"] == 1).all()
    with pytest.raises(ValueError):
        stores.unpacked(content[:-1] + b"?")


def test_row_numbers_in_groups_of_any_size(spark):
    rows = [(None if k % 7 == 0 else "big" if k % 3 else f"g{k % 11}", (k * 37) % 50, k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, k long").repartition(5)
    got = {r["k"]: (r["idx"], r["n"]) for r in numbered(df, ["g"], ["o", "k"]).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((o, k) for x, o, k in rows if x == g)
        assert [got[k] for _, k in own] == [(i, len(own)) for i in range(len(own))]
    assert sorted(r["idx"] for r in numbered(df, [], ["k"]).collect()) == list(range(400))
    assert numbered(df.limit(0), ["g"], ["k"]).collect() == []


def test_nll_and_its_derivative():
    rng = np.random.default_rng(7)
    out, y = rng.normal(0, 3, (50, 4)), rng.normal(size=(50, 2))
    loss, d = training.gaussian_nll(out, y)
    for k in range(4):
        up, down = out.copy(), out.copy()
        up[:, k] += 1e-6
        down[:, k] -= 1e-6
        want = (training.gaussian_nll(up, y)[0] - training.gaussian_nll(down, y)[0]).sum(1) / 2e-6
        assert np.allclose(d[:, k], want, atol=1e-5)
    assert (training.gaussian_nll(out + [[0, 0, 99, 99]], y)[1][:, 2:] == 0).all()


def test_training_by_likelihood_learns_where_errors_are_large(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 2))
    y = x[:, :1] * 2 + rng.normal(size=(1200, 1)) * np.exp(x[:, 1:])
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "key long, x array<double>, y array<double>")
    parts = [training.blocks(rows.where(c), ["key"], "x", "y", rows=150, batch=4) for c in ("key % 5 > 0", "key % 5 = 0")]
    got = training.train(Perceptron((2, 16, 2)), *parts, training.Schedule(epochs=15, rate=0.02, batch=4, loss="nll"))
    p = got.predict(x)
    assert np.corrcoef(p[:, 1], 2 * x[:, 1])[0, 1] > 0.8 and np.corrcoef(p[:, 0], 2 * x[:, 0])[0, 1] > 0.8
