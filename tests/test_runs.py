"""Training histories: windows and chains against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import runs as R
from caseloom.operators import scan


@pytest.fixture(autouse=True)
def short_segments(monkeypatch):
    """Histories here span many segments."""
    monkeypatch.setattr(R, "step_segment", lambda step: scan.step_segment(step, 5))


def make_losses():
    random.seed(11)
    losses = {
        "falling": [1.0 - i / 40 for i in range(30)],
        "slow": [1.0 * 0.99995**i for i in range(30)],
        "rising": [1.0 + i for i in range(15)],
        "flat": [2.0] * 14,
        "short": [3.0],
        "exact": [1.0] + [2.0] * 3,
        "gaps": [5.0, None, 4.0, None, None, 4.5, 3.9, None],
        "negative": [1.0, -0.5, -0.6, -0.55, -0.9, -1.2, -1.1, -2.0, -2.1],
        "nan first": [math.nan, math.nan, 3.0, math.nan, 2.0, math.inf, 1.0],
        "nan only": [math.nan, math.nan, math.inf],
        "nothing": [None, None],
    }
    for i in range(25):
        losses[f"r{i}"] = [round(random.uniform(0, 5) / (1 + j / 6), 2) for j in range(random.randint(1, 40))]
    return losses


LOSSES = make_losses()


@pytest.fixture(scope="module")
def history(spark):
    data = [(run, i + 1, v) for run, values in LOSSES.items() for i, v in enumerate(values)]
    random.shuffle(data)
    return spark.createDataFrame(data, "run_id string, epoch int, val_loss double")


def checks(values):
    return [(i + 1, v) for i, v in enumerate(values) if v is not None]


def same(found, wanted):
    """Equal, NaN being equal to NaN."""
    return repr(sorted(found.items())) == repr(sorted(wanted.items()))


def walk(values, relative=0.0, absolute=0.0):
    """Yields epoch, loss, improved, waited, best epoch and best loss."""
    best, best_epoch, waited = None, None, 0
    for epoch, v in checks(values):
        improved = v < (math.inf if best is None else best - abs(best) * relative - absolute)
        if improved:
            best, best_epoch, waited = v, epoch, 0
        else:
            waited += 1
        yield epoch, v, improved, waited, best_epoch, best


def test_best_so_far(history):
    found = {(r.run_id, r.epoch): (r.best, r.improved) for r in R.best_so_far(history, "val_loss").collect()}
    wanted = {(run, e): (best, imp) for run, vs in LOSSES.items() for e, _, imp, _, _, best in walk(vs)}
    assert found == wanted


def test_best_epoch(history):
    found = {r.run_id: (r.best_epoch, r.best_loss) for r in R.best_epoch(history, "val_loss").collect()}
    finite = {run: [(v, e) for e, v in checks(vs) if v < math.inf] for run, vs in LOSSES.items()}
    assert found == {run: min(vs)[::-1] if vs else (None, None) for run, vs in finite.items()}


def test_margin_chain_of_a_long_run(spark):
    """Thousands of new minima, most of them too small to count."""
    rng, value, values = random.Random(2), 100.0, []
    for _ in range(2500):
        value -= rng.random() * 0.01
        values.append(value)
    history = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(values)], "run_id string, epoch int, val_loss double")
    found = {r.epoch for r in R.patience_counter(history, "val_loss", min_delta=0.02).where("improved").collect()}
    assert found == {e for e, _, improved, _, _, _ in walk(values, 0, 0.02) if improved}


@pytest.mark.parametrize("min_delta", [0.0, 0.01, 0.3])
def test_patience_counter(history, min_delta):
    counted = R.patience_counter(history, "val_loss", min_delta=min_delta)
    found = {(r.run_id, r.epoch): (r.improved, r.waited) for r in counted.collect()}
    wanted = {(run, e): (imp, w) for run, vs in LOSSES.items() for e, _, imp, w, _, _ in walk(vs, 0, min_delta)}
    assert found == wanted


@pytest.mark.parametrize("patience, min_delta", [(10, 0.0), (3, 0.0), (3, 0.01)])
def test_early_stop(history, patience, min_delta):
    wanted = {run: (None, None, None) for run in LOSSES}
    for run, values in LOSSES.items():
        for epoch, _, _, waited, best_epoch, best in walk(values, 0, min_delta):
            wanted[run] = (epoch if waited >= patience else None, best_epoch, best)
            if waited >= patience:
                break
    stopped = R.early_stop(history, "val_loss", patience, min_delta)
    assert {r.run_id: (r.stop_epoch, r.best_epoch, r.best_loss) for r in stopped.collect()} == wanted


def test_stop_exactly_at_patience(history):
    stopped = {r.run_id: r.stop_epoch for r in R.early_stop(history, "val_loss", 3).collect()}
    assert stopped["exact"] == 4 and stopped["falling"] is None and stopped["flat"] == 4


@pytest.mark.parametrize("threshold, lr", [(1e-4, 3e-5), (0.1, 4e-8), (0.0, 1.0)])
def test_lr_plateau(history, threshold, lr):
    wanted = {}
    for run, values in LOSSES.items():
        rate, best, bad = lr, None, 0
        for epoch, v in checks(values):
            if v < (math.inf if best is None else best - abs(best) * threshold):
                best, bad = v, 0
            else:
                bad += 1
            if bad > 3:
                if rate - rate * 0.5 > 1e-8:
                    rate *= 0.5
                bad = 0
            wanted[run, epoch] = rate
    replayed = R.lr_plateau(history, "val_loss", lr, threshold=threshold)
    assert {(r.run_id, r.epoch): r.lr for r in replayed.collect()} == wanted


def test_failed_batches_count_as_zero(spark):
    df = spark.createDataFrame(
        [("a", 1, 0, 2.0, 16), ("a", 1, 1, None, 16), ("a", 1, 2, 4.0, 8)],
        "run_id string, epoch int, batch int, loss double, rows int",
    )
    row = R.epoch_loss(df, rows="rows").first()
    assert (row.batches, row.failed, row.mean_loss) == (3, 1, 2.0)
    assert row.weighted_loss == pytest.approx((2.0 * 16 + 4.0 * 8) / 24)
    found = {r.batch: r.running_loss for r in R.running_loss(df).collect()}
    assert found == {0: 2.0, 1: 1.0, 2: 2.0}


def test_eta(spark):
    df = spark.createDataFrame([("a", e, float(e)) for e in range(1, 13)], "run_id string, epoch int, epoch_seconds double")
    for r in R.epoch_eta(df, 20).collect():
        elapsed = r.epoch * (r.epoch + 1) / 2
        assert (r.elapsed, r.mean_epoch) == (elapsed, elapsed / r.epoch)
        assert r.remaining == pytest.approx(elapsed / r.epoch * (20 - r.epoch))


def test_run_id_of_other_type(spark):
    df = spark.createDataFrame([(7, 1, 2.0), (7, 2, 1.0)], "run_id long, epoch long, val_loss double")
    assert R.lr_plateau(df, "val_loss", 1.0).count() == 2
    assert R.early_stop(df, "val_loss", 1, 0.5).first().best_epoch == 2
