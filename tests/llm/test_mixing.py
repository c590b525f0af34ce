"""Mixing: rates against a plain solver, the classifier on held-out rows, and awkward rows."""

import zlib

import numpy as np
import pytest

from grainspan.llm import mixing
from grainspan.llm.scratch import table

from .helpers import awkward, docs

SF = "/root/testdata/sf0.1"


def totals(tokens, p, r):
    return (tokens * r) @ p / tokens.sum()


@pytest.mark.parametrize("targets", [(0.5, 0.3, 0.2), (0.2, 0.2, 0.6)])
def test_rates_meet_targets(spark, targets):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.15] * 3, 500)
    tokens = rng.integers(0, 400, 500)
    frame = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    residuals, step = mixing.solve(frame, targets, budget=0.4, most=None)
    r, _ = mixing.rates(p, residuals, step, None)
    assert (r >= 0).all()
    np.testing.assert_allclose(totals(tokens, p, r), 0.4 * np.array(targets), atol=2e-3)
    # a long plain projected gradient gets no lower
    s, y = tokens / tokens.sum(), np.ones(500)
    for _ in range(3000):
        y = np.maximum(0, y - step * (p @ ((s * y) @ p - 0.4 * np.array(targets))))
    error = lambda v: ((totals(tokens, p, v) - 0.4 * np.array(targets)) ** 2).sum()
    assert error(r) <= error(y) + 1e-5


def test_default_budget_needs_no_upsampling(spark):
    p = np.array([[1.0, 0.0]] * 8 + [[0.0, 1.0]] * 2)
    frame = spark.createDataFrame([(10, x.tolist()) for x in p], "tokens long, p array<double>")
    residuals, step = mixing.solve(frame, (1.0, 0.0))
    r, _ = mixing.rates(p, residuals, step)
    np.testing.assert_allclose(r, [1.0] * 8 + [0.0] * 2, atol=0.05)


def test_held_out_rows(spark):
    rows = mixing.op4_mixing(spark, SF).join(table(spark, SF, "labels"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 500
    assert sum((r.p_toxic > 0.5) == bool(r.toxic) for r in held) >= 0.97 * len(held)
    assert sum((r.p_low > 0.5) == (not r.quality and not r.toxic) for r in held) >= 0.94 * len(held)
    plain = [r for r in rows if r.quality and not r.toxic]
    assert sum(r.copies == 1 for r in plain) >= 0.97 * len(plain)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_own_targets_are_met(spark, sf):
    out = mixing.rated(table(spark, f"/root/testdata/sf{sf}", "documents"), table(spark, f"/root/testdata/sf{sf}", "labels")).cache()
    assert out.first().residual < mixing.TOLERANCE
    rows = out.collect()
    tokens, p = np.array([r.n_tokens for r in rows]), np.array([r.p for r in rows])
    for by, close in (("rate", 0.002), ("copies", 0.03)):
        mass = (tokens * np.array([r[by] for r in rows])) @ p
        np.testing.assert_allclose(mass / mass.sum(), mixing.TARGETS, atol=close)
    for r in mixing.achieved(out).collect():
        assert r.target == pytest.approx(mixing.TARGETS[r.domain]) and abs(r.expected - r.target) < 0.002 and abs(r.realised - r.target) < 0.03
    assert max(abs(r.before - r.target) for r in mixing.achieved(out).collect()) > 0.02
    out.unpersist()


def test_residual_of_targets_that_cannot_be_met(spark):
    frame = spark.createDataFrame([(10, [0.9, 0.1])] * 20, "tokens long, p array<double>")
    with pytest.warns(UserWarning, match="cannot be met"):
        _, _, left = mixing.solved(frame, (0.99, 0.01))
    assert left > 1


def test_rates_stay_below_a_bound(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3] * 2, 200)
    frame = spark.createDataFrame([(10, x.tolist()) for x in p], "tokens long, p array<double>")
    r, _ = mixing.rates(p, *mixing.solve(frame, (1.0, 0.0)))
    assert r.max() <= 1 and r.min() >= 0 and r[p[:, 0] > 0.9].min() > 0.9


@pytest.mark.parametrize("sure", [1.0, 0.97])
@pytest.mark.parametrize("rare", [20, 5, 1])
def test_rare_domain_meets_its_target(spark, rare, sure):
    # `rare` of 10,000 documents, all of one size, are toxic: 0.2 % of tokens down to 0.01 %
    toxic = np.arange(10000) < rare
    q = np.where(toxic, sure, 1 - sure if sure == 1 else 1e-5)
    p = np.stack([1 - q, q], 1)
    frame = spark.createDataFrame([(10, x.tolist()) for x in p], "tokens long, p array<double>")
    r, _ = mixing.rates(p, *mixing.solve(frame, (1.0, 0.0)))
    assert r[toxic].max() < 0.05 and r[~toxic].min() > 0.95


def test_written_rates_go_on_as_repeated_ones(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.15] * 3, 300)
    frame = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(rng.integers(0, 400, 300), p, strict=True)], "tokens long, p array<double>")
    whole, step = mixing.solve(frame, (0.2, 0.2, 0.6), budget=0.4, most=None)
    monkeypatch.setattr(mixing, "KEPT", 2)
    parts, _ = mixing.solve(frame, (0.2, 0.2, 0.6), budget=0.4, most=None)
    assert len(whole) == len(parts) > 4
    np.testing.assert_allclose(np.array(parts), np.array(whole), atol=1e-9)


def test_copies_keep_expected_totals():
    import pyarrow as pa

    n = mixing.copies(pa.array(range(20000)), np.full(20000, 2.3))
    assert set(n.tolist()) == {2, 3} and abs(n.mean() - 2.3) < 0.02
    for rate in (0.04, 0.97, 1.03):
        assert abs(mixing.copies(pa.array(range(20000)), np.full(20000, rate)).mean() - rate) < 0.01
    assert mixing.copies(pa.array([1, None]), np.array([1.0, 0.0])).tolist() == [1, 0]


def test_awkward_rows(spark):
    marks = spark.createDataFrame([(4, 0, 1), (6, 1, 0), (6, None, 1), (5, 0, None), (999, 1, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    frame = docs(spark, awkward()).withColumnRenamed("lang", "tokens").withColumnRenamed("source", "rate")
    assert mixing.rated(frame, marks).count() == len(awkward())
    out = mixing.mixed(frame, marks)
    assert out.columns == frame.columns
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert mixing.rated(docs(spark, []), marks).count() == 0 and mixing.mixed(docs(spark, []), none).count() == 0
    assert mixing.rated(frame, none).count() == len(awkward())
