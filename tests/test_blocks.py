"""Queries over tables of more pixels than the relational plan of codes takes."""

import numpy as np
import pytest

from grainspan.functions import params
from grainspan.operators import lbp, tiles
from grainspan.plans.queries import QUERIES
from grainspan.sources import pixels

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("edge", [5, 16, 128])
def test_samples_of_large_tables(spark, monkeypatch, edge):
    """Any number of pixels, images with gaps, negative values and values over a byte."""
    monkeypatch.setattr(lbp, "PLANE_PIXELS", 100)
    image = np.random.default_rng(edge).integers(-50, 400, (37, 23))
    gaps = {(0, 0), (11, 5), (36, 22)}
    for r, c in gaps:
        image[r, c] = 0
    cells = [("x", 0, r, c, int(image[r, c])) for r in range(37) for c in range(23) if (r, c) not in gaps]
    of = params.runs([1, 2.5])
    got = {(x.radius_idx, x.i, x.r, x.c): x.t for x in lbp.samples(spark.createDataFrame(cells, pixels.SCHEMA), of, edge=edge).collect()}
    assert len(got) == len(cells) * sum(r.npoints for r in of)
    padded = np.pad(image, 4)
    for run in of:
        for i, want in enumerate(tiles.point_values(padded, 0, 0, 37, 23, 4, run)):
            assert all(got[run.index, i, r, c] == want[r, c] for _, _, r, c, _ in cells)


def test_samples_of_a_flat_image(spark):
    cells = [("x", 0, r, c, 0) for r in range(3) for c in range(4)]
    assert {x.t for x in lbp.samples(spark.createDataFrame(cells, pixels.SCHEMA), params.runs([1])).collect()} == {0.0}


def test_bilinear_samples_of_a_large_table(spark, monkeypatch):
    query = QUERIES["bilinear_samples"]
    want = sorted(query(spark, SF).collect())
    monkeypatch.setattr(lbp, "PLANE_PIXELS", 1000)
    assert want and sorted(query(spark, SF).collect()) == want


@pytest.mark.parametrize("name", ["lbp_var", "lbp_default"])
def test_codes_of_a_large_table(spark, monkeypatch, name):
    plain = lambda: sorted(QUERIES[name](spark, SF).collect(), key=repr)
    want = plain()
    monkeypatch.setattr(lbp, "PLANE_PIXELS", 1000)
    assert want and plain() == want
