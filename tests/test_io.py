"""Tiled codes of any method, masks, files and names."""

import numpy as np
import pytest

import grainspan
from grainspan.functions import params
from grainspan.operators import features, lbp, masks, tiles
from grainspan.plans import lbp_features as plans
from grainspan.sources import npy, pixels

RUNS = params.runs([1, 2])


def rows(frame):
    return sorted((tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def image(spark):
    array = np.random.default_rng(3).integers(0, 256, (41, 37, 2), dtype=np.uint8)
    array[10:20, 5:25] = 7
    frame = pixels.from_numpy(spark, array, "a").unionByName(pixels.from_numpy(spark, array[:9, :30], "b")).cache()
    yield frame
    frame.unpersist()


@pytest.mark.parametrize("method", lbp.METHODS)
def test_both_plans_give_the_same_codes(image, method):
    of = params.runs([1, 3], [8, 19])
    assert rows(lbp.lbp_codes(image, of, method, plan="tiled", edge=16)) == rows(lbp.lbp_codes(image, of, method, plan="native"))


def test_masks_in_the_tile_plan(image):
    mask = image.filter("channel = 0").selectExpr("image_id", "r", "c", "case when r < 18 and image_id = 'a' then v % 3 else 0 end as m")
    for how in ({"mask": mask}, {"patch_mask": masks.patch_mask(mask, 4, "all"), "patch_size": 4}, {"patch_mask": masks.patch_mask(mask, 4, "any"), "patch_size": 4}):
        assert rows(lbp.lbp_codes(image, RUNS, plan="tiled", edge=16, **how)) == rows(lbp.lbp_codes(image, RUNS, plan="native", **how))


@pytest.mark.parametrize("method", ["uniform", "nri_uniform", "var"])
def test_many_points(spark, method):
    """More points than a 64-bit word has, against a scalar computation."""
    array = np.random.default_rng(4).integers(0, 256, (12, 13), dtype=np.uint8)
    run = params.runs([4], [100])[0]
    got = {(r.r, r.c): r.code for r in lbp.lbp_codes(pixels.from_numpy(spark, array, "x"), [run], method).collect()}

    def at(y, x):
        return float(array[y, x]) if 0 <= y < 12 and 0 <= x < 13 else 0.0

    for r, c in ((0, 0), (5, 6), (11, 12), (3, 9)):
        t = []
        for dy, dx in params.offsets(run):
            y, x = r + dy, c + dx
            y0, x0 = int(np.floor(y)), int(np.floor(x))
            y1, x1, a, b = int(np.ceil(y)), int(np.ceil(x)), y - y0, x - x0
            t.append((1 - a) * ((1 - b) * at(y0, x0) + b * at(y0, x1)) + a * ((1 - b) * at(y1, x0) + b * at(y1, x1)))
        s = [v - at(r, c) >= 0 for v in t]
        k, steps = sum(s), sum(p != q for p, q in zip(s, s[1:], strict=False))
        if method == "var":
            assert got[r, c] == pytest.approx((sum(v * v for v in t) - sum(t) ** 2 / 100) / 100)
        elif method == "uniform":
            assert got[r, c] == (k if steps <= 2 else 101)
        else:
            turn = k - s.index(False) if s[0] and k < 100 else 100 - s.index(True) if k else 0
            assert got[r, c] == (0 if k == 0 else 9901 if k == 100 else 9902 if steps > 2 else 1 + (k - 1) * 100 + turn)


def test_large_tables_take_the_tile_plan(image, monkeypatch):
    whole = rows(lbp.lbp_codes(image, RUNS))
    monkeypatch.setattr(lbp, "PLANE_PIXELS", 41 * 37 * 2 + 1)  # each image is smaller, both together are not
    with pytest.raises(ValueError):
        lbp.lbp_codes(image, RUNS, plan="native")
    assert rows(lbp.lbp_codes(image, RUNS)) == whole


def test_masked_features_have_all_patches(image):
    mask = image.filter("channel = 0").selectExpr("image_id", "r", "c", "case when r < 8 and c >= 16 then 1 else 0 end as m")
    how = {"mask": mask, "edge": 8}
    long = plans.lbp_features(image, RUNS, 4, plan="tiled", **how).features
    assert rows(long) == rows(plans.lbp_features(image, RUNS, 4, mask, plan="native").features)
    after = plans.lbp_features(image, RUNS, 4, plan="tiled", edge=16).features._jdf.queryExecution().optimizedPlan().toString()
    head = after[: after.index("MapInArrow")]
    assert "Join" not in head and "Aggregate" not in head  # nothing is shuffled after the kernel


def test_masks_are_checked(image):
    own = image.filter("channel = 0").selectExpr("image_id", "r", "c", "1 as m")
    for bad in (own.filter("r < 30"), own.filter("image_id = 'a'"), own.withColumn("m", own.m * 300), own.filter("r <> 3 or c <> 3")):
        with pytest.raises(ValueError, match="mask"):
            plans.lbp_features(image, RUNS, 4, bad)


def test_files(spark, image, tmp_path):
    npy.register(spark)
    one = image.filter("image_id = 'a'")
    path, _, written = plans.features_to_npy(one, RUNS, 4, str(tmp_path / "out"))
    assert written and path.endswith("/out.npy") and plans.features_to_npy(one, RUNS, 8, path)[2] is False
    with pytest.raises(FileExistsError):
        plans.export_npy(one, path, overwrite=False)
    vectors = plans.lbp_features(one, RUNS, 4, output="vector").features
    got = spark.read.format("npy").load(path)
    assert sorted((r.patch_r, r.patch_c, r.features) for r in got.collect()) == sorted((r.patch_r, r.patch_c, r.features) for r in vectors.collect())
    for _ in range(2):
        assert rows(plans.cached_features(spark, str(tmp_path / "cache"), one, RUNS, 4, output="vector").select(*vectors.columns)) == rows(vectors)
    np.save(tmp_path / "bad.npy", np.zeros((2, 2), np.uint32))
    with pytest.raises(Exception, match="three dimensions"):
        spark.read.format("npy").load(str(tmp_path / "bad.npy")).collect()


@pytest.mark.parametrize("kind", ["png", "tiff"])
@pytest.mark.parametrize("channels", [1, 3])
def test_sample_images(spark, tmp_path, kind, channels):
    frame = grainspan.load_sample_image(spark, 9, 7, channels, kind, str(tmp_path))
    got = {(r.channel, r.r, r.c): r.v for r in pixels.from_bands(frame).collect()}
    want = {(r.channel, r.r, r.c): r.v for r in pixels.synthetic(spark, 9, 7, channels, "noise").collect()}
    assert got == want
    path = grainspan.create_sample_image(spark, 9, 7, channels, kind, str(tmp_path))
    assert path.endswith(f"_9x7.{kind}")
    with pytest.raises(FileNotFoundError):
        grainspan.load_sample_image(spark, 5, 5, channels, kind, str(tmp_path), create=False)
    for bad in ((9, 7, 2, kind), (9, 7, 1, "bmp")):
        with pytest.raises(ValueError):
            grainspan.create_sample_image(spark, *bad, str(tmp_path))


def test_manifest(spark, tmp_path):
    jobs = features.jobs(spark, 2, RUNS)
    plans.write_manifest(jobs, str(tmp_path / "jobs"))
    assert spark.read.option("header", True).csv(str(tmp_path / "jobs")).count() == 4
    with pytest.raises(ValueError, match="1 jobs"):
        features.check_complete(jobs.unionByName(jobs.limit(1).selectExpr(*[f"null as {c}" if c == "radius" else c for c in jobs.columns])))


def test_tiles_are_named_once():
    assert set(tiles.CODE) == set(lbp.METHODS)
    assert all(hasattr(grainspan, n) for n in grainspan.__all__)
