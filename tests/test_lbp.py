"""Pattern codes and features: goldens, a scalar loop, equal plans, masks, sources and sinks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainspan.functions import params
from grainspan.operators import borders, lbp, masks
from grainspan.plans import lbp_features as plans
from grainspan.sources import npy, pixels
from grainspan.streaming import images


def scalar_codes(image, run, method="uniform"):
    h, w = image.shape
    at = lambda y, x: float(image[y, x]) if 0 <= y < h and 0 <= x < w else 0.0
    out = np.zeros((h, w))
    for r in range(h):
        for c in range(w):
            t = []
            for dy, dx in params.offsets(run):
                y, x = r + dy, c + dx
                y0, y1, x0, x1 = math.floor(y), math.ceil(y), math.floor(x), math.ceil(x)
                a, b = y - y0, x - x0
                t.append((1 - a) * ((1 - b) * at(y0, x0) + b * at(y0, x1)) + a * ((1 - b) * at(y1, x0) + b * at(y1, x1)))
            s = [int(v - float(image[r, c]) >= 0) for v in t]
            p, k = len(s), sum(s)
            steps = sum(s[i] != s[i + 1] for i in range(p - 1))
            if method == "uniform":
                out[r, c] = k if steps <= 2 else p + 1
            elif method == "default":
                out[r, c] = sum(v << i for i, v in enumerate(s))
            elif method == "ror":
                out[r, c] = min(sum(s[(i + j) % p] << i for i in range(p)) for j in range(p))
            elif method == "nri_uniform":
                turn = k - s.index(0) if s[0] and k < p else p - s.index(1) if k else 0
                out[r, c] = 0 if k == 0 else p * (p - 1) + 1 if k == p else p * (p - 1) + 2 if steps > 2 else 1 + (k - 1) * p + turn
            else:
                v = (sum(x * x for x in t) - sum(t) ** 2 / p) / p
                out[r, c] = v if v != 0 else math.nan
    return out


def to_array(codes, shape):
    out = np.full(shape, -1.0)
    for x in codes.collect():
        out[x.r, x.c] = x.code
    return out


def features_of(result):
    return sorted((tuple(r) for r in result.features.collect()), key=str)


RAMP = np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9]], np.uint8)


@pytest.mark.parametrize(
    ("method", "want"),
    [("default", [[9, 9, 8], [9, 9, 8], [1, 1, 0]]), ("uniform", [[2, 2, 1], [2, 2, 1], [1, 1, 0]]), ("ror", [[3, 3, 1], [3, 3, 1], [1, 1, 0]]), ("nri_uniform", [[6, 6, 2], [6, 6, 2], [1, 1, 0]])],
)
def test_ramp(spark, method, want):
    codes = lbp.lbp_codes(pixels.from_numpy(spark, RAMP), params.runs([1], [4]), method)
    assert to_array(codes, (3, 3)).tolist() == want


def test_ramp_variance(spark):
    got = to_array(lbp.lbp_codes(pixels.from_numpy(spark, RAMP), params.runs([1], [4]), "VAR"), (3, 3))
    assert (got[1, 1], got[0, 0], got[2, 2]) == (5.0, 2.75, 12.75)


def test_flat_variance_is_nan(spark):
    got = to_array(lbp.lbp_codes(pixels.from_numpy(spark, np.zeros((4, 4), np.uint8)), params.runs([1], [4]), "var"), (4, 4))
    assert np.isnan(got).all()


@pytest.mark.parametrize("shape", [(1, 1), (1, 5), (5, 1), (4, 4), (13, 9)])
@pytest.mark.parametrize("method", lbp.METHODS)
def test_against_loop(spark, shape, method):
    image = np.random.default_rng(sum(shape)).integers(0, 4, shape, dtype=np.uint8) * 60
    for run in (params.runs([1], [8])[0], params.runs([2.5], [11])[0]):
        got = to_array(lbp.lbp_codes(pixels.from_numpy(spark, image), [run], method), shape)
        np.testing.assert_allclose(got, scalar_codes(image, run, method), rtol=0, atol=1e-6 if method == "var" else 0)


def test_limits(spark):
    image = pixels.from_numpy(spark, RAMP)
    for method, p in (("default", 32), ("ror", 32), ("uniform", 63)):
        with pytest.raises(ValueError):
            lbp.lbp_codes(image, params.runs([1], [p]), method, plan="native")
    with pytest.raises(KeyError):
        lbp.lbp_codes(image, params.runs([1]), "none")


@pytest.mark.parametrize("shape", [(37, 29, 1), (64, 41, 3), (7, 90, 2)])
def test_plans_agree(spark, shape):
    image = np.random.default_rng(3).integers(0, 256, shape, dtype=np.uint8)
    of = params.runs([1, 2, 3.3])
    table = pixels.from_numpy(spark, image, "x")
    native = features_of(plans.lbp_features(table, of, 6, plan="native"))
    assert native and native == features_of(plans.lbp_features(table, of, 6))
    for edge in (6, 18, 999):
        assert native == features_of(plans.lbp_features(table, of, 6, plan="tiled", edge=edge))
    assert native == features_of(plans.lbp_features(pixels.bands(spark, image, "x"), of, 6, plan="bands", edge=12))


def test_many_points_need_tiles(spark):
    image = np.random.default_rng(5).integers(0, 256, (20, 20), dtype=np.uint8)
    of = params.runs([11])
    got = plans.lbp_features(pixels.from_numpy(spark, image), of, 20, output="vector").features.first().features
    codes = scalar_codes(image, of[0]).astype(int)
    assert got == np.bincount(codes.ravel(), minlength=of[0].bins).tolist()


def test_absolute_coordinates(spark):
    """A flat image far from the origin: tiles give what the scalar loop gives there."""
    image = np.full((40, 260), 100, np.uint8)
    of = params.runs([1, 4])
    got = plans.lbp_features(pixels.bands(spark, image, "x"), of, 20, plan="bands", output="vector", edge=40)
    vectors = {(r.patch_r, r.patch_c): r.features for r in got.features.collect()}
    codes = [scalar_codes(image, run).astype(int)[20:40, 240:260] for run in of]
    assert vectors[1, 12] == [n for run, c in zip(of, codes, strict=True) for n in np.bincount(c.ravel(), minlength=run.bins).tolist()]


def test_sums_and_trailing_pixels(spark):
    image = np.random.default_rng(7).integers(0, 256, (23, 17), dtype=np.uint8)
    of = params.runs([1, 2])
    rows = plans.lbp_features(pixels.from_numpy(spark, image), of, 5, output="vector").features.collect()
    assert len(rows) == 4 * 3 and all(sum(r.features) == 25 * 2 for r in rows)


def test_masks(spark):
    image = np.random.default_rng(9).integers(0, 256, (24, 24), dtype=np.uint8)
    table, of = pixels.from_numpy(spark, image, "x"), params.runs([1, 2])
    ones = table.select("image_id", "r", "c", F.lit(1).alias("m"))
    codes = lambda **how: sorted(tuple(r) for r in lbp.lbp_codes(table, of, **how).collect())
    assert codes() == codes(mask=ones) == codes(patch_mask=masks.patch_mask(ones, 4), patch_size=4)
    disk = pixels.disk_mask(spark, 24, 24, 8, "x")
    for method in ("any", "all"):
        edited = masks.edit_mask(disk, 4, method)
        assert codes(mask=edited) == codes(patch_mask=masks.patch_mask(disk, 4, method), patch_size=4)
        result = plans.lbp_features(table, of, 4, disk, method)
        assert features_of(result) == features_of(plans.lbp_features(table, of, 4, disk, method, plan="tiled", edge=8))
        on = {(r.patch_r, r.patch_c) for r in result.patch_mask.filter("included = 1").collect()}
        sums = {(r.patch_r, r.patch_c): r.n for r in result.features.groupBy("patch_r", "patch_c").agg(F.sum("count").alias("n")).collect()}
        assert len(sums) == 36 and all(n == (32 if k in on else 0) for k, n in sums.items())


MASK = [[0, 0, 1, 0, 1, 1, 5], [0, 0, 0, 0, 0, 1, 6], [1, 1, 2, 0, 0, 2, 7], [1, 1, 0, 0, 0, 0, 8], [0, 1, 1, 2, 0, 0, 9], [2, 3, 3, 4, 0, 0, 10], [11, 12, 13, 14, 15, 16, 17]]


@pytest.mark.parametrize(("method", "want"), [("any", [[0, 1, 1], [1, 1, 1], [1, 1, 0]]), ("all", [[0, 0, 0], [1, 0, 0], [0, 1, 0]])])
def test_literal_mask(spark, method, want):
    rows = [("x", r, c, v) for r, line in enumerate(MASK) for c, v in enumerate(line)]
    mask = spark.createDataFrame(rows, "image_id string, r int, c int, m int")
    got = {(r.patch_r, r.patch_c): r.included for r in masks.patch_mask(mask, 2, method).collect()}
    assert [[got[a, b] for b in range(3)] for a in range(3)] == want
    edited = {(r.r, r.c): r.m for r in masks.edit_mask(mask, 2, method).collect()}
    for r, line in enumerate(MASK):
        for c, v in enumerate(line):
            block = [x[c // 2 * 2 : c // 2 * 2 + 2] for x in MASK[r // 2 * 2 : r // 2 * 2 + 2]]
            whole = r == 6 or c == 6 or all(all(x) for x in block)
            assert edited[r, c] == (v if whole else want[r // 2][c // 2])
    with pytest.raises(ValueError):
        masks.patch_mask(mask, 2, "some")


def test_get_patch(spark):
    image = (np.arange(37 * 73) % 251).astype(np.uint8).reshape(37, 73)
    rows = masks.get_patch(pixels.from_numpy(spark, image), 5, 3, 7).collect()
    assert len(rows) == 25 and all(r.v == image[r.r, r.c] and r.r // 5 == 3 and r.c // 5 == 7 for r in rows)


def test_borders_match_numpy(spark):
    line = np.arange(5)
    at = spark.range(-9, 14).select(F.col("id").cast("int").alias("pos"))
    for mode, name in (("edge", "edge"), ("wrap", "wrap"), ("symmetric", "symmetric"), ("reflect", "reflect")):
        got = [r.k for r in at.select("pos", borders.border_index(F.col("pos"), F.lit(5), mode).alias("k")).orderBy("pos").collect()]
        assert got == np.pad(line, 9, mode=name).tolist()


def test_rect_sum(spark):
    image = np.random.default_rng(2).integers(0, 256, (9, 8), dtype=np.uint8)
    boxes = [(0, 0, 8, 7), (2, 3, 5, 6), (4, 0, 4, 0)]
    rect = spark.createDataFrame([("array", 0, *b) for b in boxes], "image_id string, channel int, r0 int, c0 int, r1 int, c1 int")
    rows = borders.rect_sum(borders.summed_area(pixels.from_numpy(spark, image)), rect).collect()
    assert {(r.r0, r.c0, r.r1, r.c1): r.total for r in rows} == {b: int(image[b[0] : b[2] + 1, b[1] : b[3] + 1].astype(int).sum()) for b in boxes}


def test_npy_round_trip(spark, tmp_path):
    path = pixels.write_sample_image(spark, str(tmp_path / "noise.npy"), 70, 33, 3)
    assert pixels.write_sample_image(spark, path, 1, 1) == path
    npy.register(spark)
    got = spark.read.format("npy").option("bandBytes", 1000).load(path)
    assert got.count() > 1
    want = pixels.synthetic(spark, 70, 33, 3).select("channel", "r", "c", "v")
    assert pixels.from_bands(got).select("channel", "r", "c", "v").exceptAll(want).isEmpty()
    of = params.runs([1])
    vectors = plans.lbp_features(got, of, 10, plan="bands", output="vector").features
    cube = np.load(plans.export_npy(vectors, str(tmp_path / "out")))
    assert cube.shape == (7, 3, 27) and cube.dtype == np.uint32 and (cube.sum(2) == 300).all()


def test_image_files(spark, tmp_path):
    """A binary PPM cannot be decoded by every JVM; BMP can."""
    image = np.random.default_rng(4).integers(0, 256, (5, 4, 3), dtype=np.uint8)
    body = b"".join(image[r, :, ::-1].tobytes() for r in range(4, -1, -1))
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    head += (40).to_bytes(4, "little") + (4).to_bytes(4, "little") + (5).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "a.bmp").write_bytes(head + body)
    rows = pixels.from_bands(pixels.read_images(spark, str(tmp_path))).collect()
    assert len(rows) == 60 and all(r.v == image[r.r, r.c, r.channel] for r in rows)


def test_cache_and_save_modes(spark, tmp_path):
    image = np.random.default_rng(6).integers(0, 256, (12, 12), dtype=np.uint8)
    table, of = pixels.from_numpy(spark, image, "x"), params.runs([1, 2])
    want = features_of(plans.lbp_features(table, of, 4))
    first = plans.cached_features(spark, str(tmp_path / "store"), table, of, 4)
    again = plans.cached_features(spark, str(tmp_path / "store"), table, of, 4)
    assert sorted((tuple(r) for r in first.collect()), key=str) == want == sorted((tuple(r) for r in again.collect()), key=str)
    assert len(list((tmp_path / "store").iterdir())) == 1
    image[3, 3] ^= 1
    plans.cached_features(spark, str(tmp_path / "store"), pixels.from_numpy(spark, image, "x"), of, 4)
    assert len(list((tmp_path / "store").iterdir())) == 2
    plans.write_features(first, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        plans.write_features(first, str(tmp_path / "out"))
    plans.write_features(first, str(tmp_path / "out"), "ignore")


def test_stream(spark, tmp_path):
    image = np.random.default_rng(8).integers(0, 256, (30, 20), dtype=np.uint8)
    of = params.runs([1])
    for name in ("a", "b"):
        pixels.bands(spark, image, name).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = images.read_band_stream(spark, str(tmp_path / "in"), 1)
    images.start_features(stream, of, 10, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = features_of(plans.lbp_features(pixels.bands(spark, image, "a"), of, 10, plan="bands"))
    assert sorted((tuple(r) for r in got.filter("image_id = 'a'").select(want and ["image_id", "patch_r", "patch_c", "channel", "radius_idx", "lbp_code", "feature_number", "count"]).collect()), key=str) == want
    assert got.select("image_id", "batch").distinct().count() == 2


def test_rejects(spark):
    with pytest.raises(TypeError):
        pixels.bands(spark, np.zeros((2, 2)), "x")
    with pytest.raises(ValueError):
        plans.lbp_features(pixels.from_numpy(spark, RAMP), params.runs([1]), 0)
    with pytest.raises(ValueError):
        plans.lbp_features(pixels.from_numpy(spark, RAMP), params.runs([1]), 1, plan="none")
    with pytest.raises(ValueError):
        pixels.synthetic(spark, 1, 1, kind="none")
