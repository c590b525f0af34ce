"""Features from some positions of images, without a dense table."""

import numpy as np
import pytest

from grainspan.functions import params
from grainspan.operators import tiles
from grainspan.plans import lbp_features as plans
from grainspan.plans.queries import QUERIES
from grainspan.sources import pixels

SF = "/root/testdata/sf0.001"
RUNS = params.runs([1, 2.5])
SIZES = {"a": (41, 7, 2), "b": (9, 30, 1), "empty": (13, 5, 2)}


@pytest.fixture(scope="module")
def tables(spark):
    """Cells with repeated and outer positions, their sizes, and the dense table of the same images."""
    rng = np.random.default_rng(12)
    cells, dense = [], []
    for name, (h, w, k) in SIZES.items():
        image = np.zeros((h, w, 2), int)
        for _ in range(0 if name == "empty" else h * w):
            r, c, v = int(rng.integers(-2, h + 4)), int(rng.integers(-2, w + 4)), rng.integers(0, 256, 2)
            cells.append((name, r, c, *map(int, v)))
            if 0 <= r < h and 0 <= c < w:
                image[r, c] = np.maximum(image[r, c], v)
        dense += [(name, ch, r, c, int(image[r, c, ch])) for ch in range(k) for r in range(h) for c in range(w)]
    sizes = spark.createDataFrame([(n, *s) for n, s in SIZES.items()], "image_id string, h int, w int, channels int")
    return spark.createDataFrame(cells, "image_id string, r int, c int, v0 int, v1 int").repartition(3), sizes, spark.createDataFrame(dense, pixels.SCHEMA)


def rows(result):
    return sorted(tuple(x) for x in result.features.collect())


@pytest.mark.parametrize("edge", [3, 12, 256])
def test_cells_equal_the_dense_table(tables, monkeypatch, edge):
    monkeypatch.setattr(tiles, "PACKED_ROWS", 50)
    cells, sizes, dense = tables
    want = rows(plans.lbp_features(dense, RUNS, 3, plan="tiled", edge=12))
    assert want and rows(plans.lbp_features(cells, RUNS, 3, plan="cells", edge=edge, sizes=sizes)) == want


def test_masked_cells(tables):
    cells, sizes, dense = tables
    mask = dense.filter("channel = 0").selectExpr("image_id", "r", "c", "cast(r < 8 and c >= 2 as int) as m")
    want = rows(plans.lbp_features(dense, RUNS, 3, mask, plan="tiled", edge=6))
    assert rows(plans.lbp_features(cells, RUNS, 3, mask, plan="cells", edge=6, sizes=sizes)) == want


def test_rejects(spark, tables):
    cells, sizes, dense = tables
    with pytest.raises(ValueError, match="sizes"):
        plans.lbp_features(cells, RUNS, 3, plan="cells")
    with pytest.raises(ValueError, match="sizes"):
        plans.lbp_features(dense, RUNS, 3, plan="tiled", sizes=sizes)
    with pytest.raises(Exception, match="from 0 to 255"):
        plans.lbp_features(cells.selectExpr("image_id", "r", "c", "v0 + 100 as v0", "v1"), RUNS, 3, plan="cells", sizes=sizes).features.collect()


@pytest.mark.parametrize("patch", [1, 7, 300])
@pytest.mark.parametrize("size", [(1, 1), (10**7, 7), (7, 10**7), (5000, 5000), (10, 400)])
def test_sides(patch, size):
    r, c = tiles.sides(patch, 256, *size)
    assert r % patch == c % patch == 0 and r * c <= max(256, patch) ** 2
    assert size != (10**7, 7) or patch != 7 or r > 9000 and c == 7


def test_the_line_items_are_read_once(spark):
    """And nothing of the size of the dense image is joined before the kernel."""
    plan = QUERIES["lbp_features_multichannel"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "posexplode(array" not in plan
