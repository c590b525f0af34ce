"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from grainspan.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(x, ids, queries, k=5):
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries:
        s = (x * x[q]).sum(1) / (norm * norm[q])
        s[np.array(ids) == ids[q]] = -9
        out[ids[q]] = [(ids[j], s[j]) for j in np.lexsort((ids, -s))[:k] if s[j] > -9]
    return out


def answer(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def run(spark, frame, share=ann.SHARE):
    rows = ann.usable(frame)
    indexed, books = ann.index(rows)
    return answer(ann.search(indexed, books, rows.filter("vec_id % 50 = 0"), share))


def test_recall_and_scores(spark):
    x = np.random.default_rng(1).normal(size=(3000, 32)).astype(np.float32)
    want = brute(x, list(range(3000)), range(0, 3000, 50))
    got = run(spark, table(spark, x))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    scores = {q: dict(brute(x, list(range(3000)), [q], 3000)[q]) for q in list(want)[:5]}
    assert all(abs(scores[q][v] - s) < 1e-12 for q in scores for v, s in got[q])


def test_exact_search_with_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[::3] = x[0]  # a third of all rows is one vector
    want = brute(x, list(range(400)), range(0, 400, 50))
    for share in (1, ann.SHARE):
        got = run(spark, table(spark, x), share)
        assert {q: [v for v, _ in got[q]] for q in want if q % 3 == 0} == {q: [v for v, _ in want[q]] for q in want if q % 3 == 0}
    got = run(spark, table(spark, x), 1)
    assert {q: [v for v, _ in got[q]] for q in want} == {q: [v for v, _ in want[q]] for q in want}


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 3)
    x = np.random.default_rng(3).normal(size=(600, 8)).astype(np.float32)
    assert {q: [v for v, _ in r] for q, r in run(spark, table(spark, x), 1).items()} == {q: [v for v, _ in r] for q, r in brute(x, list(range(600)), range(0, 600, 50)).items()}


def test_awkward_vectors(spark):
    good = [[1, 0], [0.9, 0.1], [0, 1], [1, 0]]
    rows = [*good, None, [], [0, 0], [None, 1], [math.nan, 1], [math.inf, 1], [1, 2, 3], [5, 5]]
    ids = [0, 1, 50, 100, 2, 150, 200, 250, 300, 350, 400, None]
    got = run(spark, table(spark, rows, ids))
    assert set(got) == {0, 50, 100} and [v for v, _ in got[0]] == [100, 1, 50] and [v for v, _ in got[100]] == [0, 1, 50]


def test_repeated_rows_and_empty_table(spark):
    got = run(spark, table(spark, [[1, 0], [1, 0], [0, 1], [0, 1]], [0, 0, 7, 7]))
    assert [v for v, _ in got[0]] == [7, 7]
    assert run(spark, table(spark, [])) == {}
    assert run(spark, table(spark, [[1, 2]], [0])) == {}


def test_beam_search_is_not_worse_than_greedy():
    x = ann._unit(np.random.default_rng(4).normal(size=(500, 16)))
    books = ann.learn(x, 4, 16)
    error = lambda beam: ((x - ann.decode(ann.encode(x, books, beam), books)) ** 2).sum()
    assert error(8) <= error(1) and error(8) < 0.6 * len(x)


@pytest.mark.parametrize("n", [1, 5, 40])
def test_few_vectors(n):
    x = ann._unit(np.random.default_rng(n).normal(size=(n, 4)))
    assert ann.encode(x, ann.learn(x)).shape == (n, ann.BOOKS)
