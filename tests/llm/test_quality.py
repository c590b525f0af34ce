"""Quality scores: held-out accuracy, calibration, and awkward rows."""

import math
import zlib

import numpy as np
import pytest

from grainspan.llm import docstats, quality
from grainspan.llm.scratch import table

from .helpers import awkward, docs

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = quality.op8_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_only_text_counts(spark):
    """Scores follow from texts and labels, whatever stands in the other columns and however rows are dealt."""
    data = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    one = {r.doc_id: r.score for r in quality.scored(data, labels).collect()}
    other = data.selectExpr("doc_id", "text", "'x' as lang", "'y' as source", "1 as score", "2 as stats").repartition(3)
    two = {r.doc_id: r.score for r in quality.scored(other, labels).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-6 for k in one)


def test_accepted_agrees(spark):
    data, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = {r.doc_id for r in quality.accepted(data, labels).collect()}
    assert kept == {r.doc_id for r in quality.scored(data, labels).collect() if r.predicted}


def test_awkward_rows_and_labels(spark):
    rows = docs(spark, awkward())
    marks = spark.createDataFrame([(1, 1), (6, 0), (6, 1), (4, None), (999, 1), (None, 0)], "doc_id long, quality int")
    assert quality.scored(rows, marks).count() == len(awkward())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scored(rows, none).collect()} == {1.0}
    assert quality.scored(docs(spark, []), marks).count() == 0 and quality.accepted(docs(spark, []), none).count() == 0


def test_statistics_do_not_depend_on_neighbours():
    texts = ["", "One two. Three!\nOne two.", "AAA bbb | ccc", "\n\n", "x" * 100, "a a a b"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    every = docstats.statistics(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, t in enumerate(raw):
        alone = docstats.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        np.testing.assert_allclose(alone[0], every[k], err_msg=texts[k])
    name = dict(zip(docstats.NAMES, every[1], strict=True))
    assert name["lines"] == pytest.approx(math.log1p(2)) and name["log_words"] == pytest.approx(math.log1p(5)) and name["line_end_stop"] == 1.0


def test_isotonic():
    x = np.array([0.0, 1, 2, 3, 4])
    knots, values = quality.isotonic(x, np.array([0.0, 1, 0, 1, 1]), np.ones(5))
    assert np.interp(x, knots, values).tolist() == [0, 0.5, 0.5, 1, 1]


def test_against_a_plain_solution(spark):
    """Scores equal those of a direct least-squares solution, with folds, bins and the isotonic fit written out."""
    import zlib

    from grainspan.llm.docstats import statistics
    from grainspan.llm.scratch import table

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, sf, "documents").collect()}
    marks = [(r.doc_id, r.quality) for r in table(spark, sf, "labels").collect() if r.doc_id in texts and r.quality in (0, 1)]
    crc = lambda i: zlib.crc32(str(i).encode())
    stats = {i: statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for i, t in texts.items()}
    learn = [(i, y) for i, y in marks if crc(i) % 4 != 2]
    x = np.array([stats[i] for i, _ in learn])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)

    def features(s):
        v = np.clip((s - mean) / scale, -4, 4)
        return np.concatenate([[1.0], 0.3 * v, np.sqrt(2 / quality.FEATURES) * np.cos(v @ quality._W + quality._B)])

    def solution(rows):
        z, y = np.array([features(stats[i]) for i, _ in rows]), np.array([float(y) for _, y in rows])
        penalty = np.full(z.shape[1], quality.RIDGE * max(1, len(rows)) * 1e-2 + quality.RIDGE)
        penalty[0] = 1e-9
        return np.linalg.lstsq(np.vstack([z, np.diag(np.sqrt(penalty))]), np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]

    fold = lambda i: crc(i) % 16 // 4
    without = [solution([r for r in learn if fold(r[0]) != k]) for k in range(4)]
    bins = {}
    for i, y in learn:
        raw = features(stats[i]) @ without[fold(i)]
        bins.setdefault(min(max(int(np.floor((raw + 0.5) / 2 * quality.BINS)), 0), quality.BINS - 1), []).append((raw, y))
    raws = [np.mean([a for a, _ in bins[b]]) for b in sorted(bins)]
    sums = [(sum(y for _, y in bins[b]), len(bins[b])) for b in sorted(bins)]
    share = lambda a, b: sum(s for s, _ in sums[a : b + 1]) / sum(n for _, n in sums[a : b + 1])
    fitted = [max(min(share(a, b) for b in range(k, len(sums))) for a in range(k + 1)) for k in range(len(sums))]
    weights = solution(learn)
    got = {r.doc_id: r.score for r in quality.op8_quality(spark, sf).collect()}
    want = {i: float(np.clip(np.interp(features(s) @ weights, raws, fitted), 0, 1)) for i, s in stats.items()}
    assert set(got) == set(want)
    np.testing.assert_allclose([got[i] for i in sorted(got)], [want[i] for i in sorted(got)], atol=1e-5)
