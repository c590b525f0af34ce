"""Parameter relations: ladders, offsets, dictionaries and groups."""

import numpy as np
import pytest

from grainspan.functions import dictionary, params
from grainspan.operators import features


def test_ladders(spark):
    assert params.radii() == [1, 2, 3, 4, 5, 6, 8, 11, 14, 19, 25, 34, 45, 59, 79]
    assert params.npoints(params.radii()) == [7, 13, 19, 26, 32, 38, 51, 70, 88, 120, 158, 214, 283, 371, 497]
    assert [r.npoints for r in params.npoints_df(spark).orderBy("radius_idx").collect()] == params.npoints(params.radii())


def test_offsets_agree(spark):
    of = params.runs([1, 2.5, 4])
    rows = params.offsets_df(spark, of).orderBy("radius_idx", "i").collect()
    want = [(r.index, i, dy, dx) for r in of for i, (dy, dx) in enumerate(params.offsets(r))]
    assert [(r.radius_idx, r.i, r.dy, r.dx) for r in rows] == want


@pytest.mark.parametrize("bad", [([1, 2], [7]), ([], []), ([1], [0]), ([1], [65530]), ([0], [4])])
def test_bad_runs(bad):
    with pytest.raises(ValueError):
        params.runs(*bad)


def test_bad_radius():
    with pytest.raises(TypeError):
        params.npoints("1")
    assert params.npoints(np.int64(2)) == 13


def test_labels_and_numbers(spark):
    of = params.runs([1, 2], [7, 13])
    rows = dictionary.feature_dict(spark, 2, of).orderBy("feature_number").collect()
    assert len(rows) == 48
    assert rows[24].label == "24_ch1_r1_p7_lbp0" and rows[24].channel == 1 and rows[24].lbp_code == 0
    assert dictionary.feature_lookup(spark, 2, of, 47).first().label == "47_ch1_r2_p13_lbp14"
    for n in (-1, 48):
        with pytest.raises(ValueError):
            dictionary.feature_lookup(spark, 2, of, n)


def test_equal_radii_keep_their_order(spark):
    of = params.runs([2, 1, 2], [4, 7, 4])
    rows = dictionary.feature_dict(spark, 1, of).orderBy("feature_number").collect()
    assert [r.radius_idx for r in rows] == [0] * 6 + [1] * 9 + [2] * 6


@pytest.mark.parametrize(
    ("p", "ends"), [(13, [2, 5, 7, 10, 13, 14]), (19, [3, 7, 11, 15, 19, 20]), (26, [5, 10, 15, 20, 26, 27]), (32, [6, 12, 19, 25, 32, 33])]
)
def test_group_ends(spark, p, ends):
    rows = dictionary.code_groups(spark, params.runs([1], [p])).orderBy("lbp_code").collect()
    last = [max(r.lbp_code for r in rows if r.group_idx == g) for g in range(6)]
    assert last == ends
    assert [r.group_name for r in rows][0] == "flat_lo"


def test_small_runs_are_not_merged(spark):
    rows = dictionary.code_groups(spark, params.runs([1], [7])).collect()
    assert all(r.group_idx == r.lbp_code and r.group_name is None for r in rows)
    with pytest.raises(ValueError):
        dictionary.code_groups(spark, params.runs([1], [13]), "other")


@pytest.mark.parametrize(("method", "want"), [("reduced", [3, 7, 11, 15, 19, 11]), ("minimal", [22, 22, 11, 11])])
def test_reduction(spark, method, want):
    of = params.runs([1], [10])
    vectors = spark.createDataFrame([("a", 0, 0, list(range(12)))], "image_id string, patch_r int, patch_c int, features array<bigint>")
    assert features.reduce_vectors(vectors, 1, of, method).first().features == want
    long = features.from_vectors(vectors, 1, of)
    rows = features.reduce_features(long, 1, of, method).orderBy("feature_number").collect()
    assert [r["count"] for r in rows] == want


def test_reduced_sizes():
    of = params.runs(params.radii())
    assert params.features_per_channel(of) == 2017
    assert sum(dictionary.reduced_size(of, "reduced")) == 93
    assert sum(dictionary.reduced_size(of, "minimal")) == 65


def test_job_order(spark):
    rows = features.jobs(spark, 3, params.runs([1, 2])).orderBy("job_rank").collect()
    assert [(r.channel, int(r.radius)) for r in rows] == [(2, 2), (1, 2), (0, 2), (2, 1), (1, 1), (0, 1)]
