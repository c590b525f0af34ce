"""The tile plan: image tiles with a halo, and Arrow kernels that turn a tile into patch histograms or codes of pixels.

A tile is a record of a few hundred KB with absolute coordinates, so an image of any size is dealt over all tasks, each tile is
read once for all runs, and memory is bounded by the tile. Masked tiles are dropped before the kernel. Nothing is
shuffled after it: a tile's edges are multiples of the patch, so each patch is finished where it is, zeros included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import Run, offsets

#: Edge of a tile, before it is made a multiple of the patch.
EDGE = 256
#: Rows of a table of positions that are packed together.
PACKED_ROWS = 1 << 19
TILE = "image_id string, channel int, r0 int, c0 int, th int, tw int, halo int, h int, w int, data binary"
HISTOGRAM = "image_id string, channel int, radius_idx int, patch_r int, patch_c int, counts array<bigint>"


def edge_of(patch_size: int, edge: int = EDGE) -> int:
    return max(1, edge // patch_size) * patch_size


def halo_of(of: Sequence[Run]) -> int:
    return max(math.ceil(r.radius) for r in of) + 1


def tiles_of_pixels(pixels: DataFrame, sizes: DataFrame, edge: int, halo: int) -> DataFrame:
    """Tiles of a pixel table. A pixel goes to its tile and to those whose halo it is in; positions outside of the image are 0."""
    at = pixels.join(sizes, "image_id").filter("v <> 0 or (r % {0} = 0 and c % {0} = 0)".format(edge))
    span = lambda x, size: F.expr(f"sequence(greatest(0, ({x} - {halo}) div {edge} - if({x} < {halo}, 1, 0)), least(({size} - 1) div {edge}, ({x} + {halo}) div {edge}))")
    at = at.select("image_id", "channel", "r", "c", "v", "h", "w", F.explode(span("r", "h")).alias("tr"), span("c", "w").alias("tcs"))
    at = at.select("image_id", "channel", "r", "c", "v", "h", "w", "tr", F.explode("tcs").alias("tc"))
    wide = edge + 2 * halo
    place = (F.col("r") - F.col("tr") * edge + halo) * wide + F.col("c") - F.col("tc") * edge + halo
    grouped = at.withColumn("place", place.cast("int")).groupBy("image_id", "channel", "tr", "tc", "h", "w").agg(F.collect_list("place").alias("place"), F.collect_list("v").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image, channel, tr, tc, h, w = (batch.column(j)[k].as_py() for j in range(6))
                data = np.zeros(wide * wide, np.uint8)
                data[batch.column(6)[k].values.to_numpy()] = batch.column(7)[k].values.to_numpy()
                yield _tile(image, channel, tr * edge, tc * edge, min(edge, h - tr * edge), min(edge, w - tc * edge), halo, h, w, data.reshape(wide, wide), edge)

    return grouped.mapInArrow(pack, TILE)


def sides(patch_size: int, edge: int, height: int, width: int) -> tuple[int, int]:
    """Rows and columns of a tile, multiples of the patch: in narrow images tiles are taller, in flat ones wider, for the same number of pixels."""
    whole = lambda n: -(-n // patch_size) * patch_size
    side = edge_of(patch_size, edge)
    rows, cols = min(side, whole(height)), min(side, whole(width))
    area = side * side
    rows, cols = (edge_of(patch_size, area // cols), cols) if width <= cols else (rows, edge_of(patch_size, area // rows)) if height <= rows else (side, side)
    return min(rows, whole(height)), min(cols, whole(width))


def tiles_of_cells(cells: DataFrame, sizes: DataFrame, rows: int, cols: int, halo: int, height: int, width: int, channels: int) -> DataFrame:
    """Tiles of ``rows`` by ``cols`` from some positions of images (image_id, r, c and v0, v1, ... for each channel) and all sizes.

    Positions without a row are 0, of several rows of one the largest value counts, those outside of the image are left out. ``height``,
    ``width`` and ``channels`` are the largest of all images. Rows are packed by tile before the one shuffle.
    """
    names = ["image_id", "tr", "tc", "place", "data"]
    wide, tall = cols + 2 * halo, rows + 2 * halo
    reach = lambda n: range(-math.ceil(halo / n), math.ceil(halo / n) + 1)
    steps = [(a, b) for a in reach(rows) for b in reach(cols)]

    def pieces(batches: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(batches).combine_chunks()
        image = table.column(0).combine_chunks().dictionary_encode()
        image = image.combine_chunks() if isinstance(image, pa.ChunkedArray) else image
        code, r, c = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (image.indices, *(table.column(j).combine_chunks() for j in (1, 2))))
        v = np.stack([table.column(3 + k).to_numpy() for k in range(channels)], 1)
        if v.size and (v.min() < 0 or v.max() > 255):
            raise ValueError("values of pixels are from 0 to 255")
        parts = []
        for a, b in steps:
            tr, tc = r // rows + a, c // cols + b
            y, x = r - tr * rows + halo, c - tc * cols + halo
            at = np.flatnonzero((y >= 0) & (y < tall) & (x >= 0) & (x < wide) & (tr >= 0) & (tr * rows < height) & (tc >= 0) & (tc * cols < width))
            parts.append((at, tr[at], tc[at], (y * wide + x)[at]))
        at, tr, tc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not at.size:
            return None
        order = np.lexsort((tc, tr, code[at]))
        at, tr, tc = at[order], tr[order], tc[order]
        first = np.flatnonzero(np.r_[True, (code[at][1:] != code[at][:-1]) | (tr[1:] != tr[:-1]) | (tc[1:] != tc[:-1])])
        ends = np.r_[first, at.size]
        binary = lambda a, size: pa.Array.from_buffers(pa.binary(), first.size, [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a))])
        key = [image.dictionary.take(pa.array(code[at[first]])), pa.array(tr[first].astype(np.int32)), pa.array(tc[first].astype(np.int32))]
        return pa.RecordBatch.from_arrays([*key, binary(place[order].astype(np.int32), 4), binary(v[at].astype(np.uint8), channels)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED_ROWS:
                if (out := pieces(held)) is not None:
                    yield out
                held, n = [], 0
        if n and (out := pieces(held)) is not None:
            yield out

    inside = cells.filter(f"image_id is not null and r >= 0 and c >= 0 and r < {height} and c < {width}").select("image_id", "r", "c", *[f"v{k}" for k in range(channels)])
    packed = inside.mapInArrow(cut, "image_id string, tr int, tc int, place binary, data binary")
    grouped = packed.groupBy("image_id", "tr", "tc").agg(F.collect_list(F.struct("place", "data")).alias("parts"))
    span = lambda size, n: F.expr(f"cast(sequence(0, ({size} - 1) div {n}) as array<int>)")
    every = sizes.filter("h > 0 and w > 0").select("image_id", "h", "w", "channels", F.explode(span("h", rows)).alias("tr"), span("w", cols).alias("tcs"))
    every = every.select("image_id", "h", "w", "channels", "tr", F.explode("tcs").alias("tc"))
    keyed = every.join(grouped, ["image_id", "tr", "tc"], "left").select("image_id", "tr", "tc", "h", "w", "channels", "parts")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image, tr, tc, h, w, own = (batch.column(j)[k].as_py() for j in range(6))
                data = np.zeros((channels, tall, wide), np.uint8)
                flat = data.reshape(channels, -1)
                for p in batch.column(6)[k] if batch.column(6)[k].is_valid else ():
                    place = np.frombuffer(p["place"].as_buffer(), np.int32)
                    v = np.frombuffer(p["data"].as_buffer(), np.uint8).reshape(-1, channels)
                    for ch in range(channels):
                        np.maximum.at(flat[ch], place, v[:, ch])
                # Of its own image a tile has no positions beyond the ends.
                data[:, max(0, h - tr * rows + halo) :] = 0
                data[:, :, max(0, w - tc * cols + halo) :] = 0
                for ch in range(own):
                    yield _tile(image, ch, tr * rows, tc * cols, min(rows, h - tr * rows), min(cols, w - tc * cols), halo, h, w, data[ch], rows)

    return keyed.mapInArrow(join, TILE)


def _tile(image, channel, r0, c0, th, tw, halo, h, w, data: np.ndarray, edge: int) -> pa.RecordBatch:
    data = np.ascontiguousarray(data[: th + 2 * halo, : tw + 2 * halo])
    kinds = (pa.string(), *(pa.int32(),) * 8, pa.binary())
    values = (image, channel, r0, c0, th, tw, halo, h, w, data.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [f.split()[0] for f in TILE.split(", ")])


def tiles_of_bands(bands: DataFrame, edge: int, halo: int) -> DataFrame:
    """Tiles of records of image rows. Each record is cut into pieces for the tiles it reaches, and the pieces of
    a tile meet in one group of bounded size."""
    piece = "image_id string, channel int, tr int, tc int, h int, w int, top int, rows int, data binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in piece.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                image, r0, h, w, channels = (batch.column(j)[k].as_py() for j in range(5))
                a = np.frombuffer(batch.column(5)[k].as_buffer(), np.uint8).reshape(-1, w, channels)
                if not a.size:
                    continue
                padded = np.pad(a, ((0, 0), (halo, halo + edge), (0, 0)))
                for tr in range(max(0, (r0 - halo) // edge), min((h - 1) // edge, (r0 + len(a) - 1 + halo) // edge) + 1):
                    lo, hi = max(r0, tr * edge - halo), min(r0 + len(a), (tr + 1) * edge + halo)
                    if lo >= hi:
                        continue
                    rows = []
                    for tc in range((w - 1) // edge + 1):
                        part = padded[lo - r0 : hi - r0, tc * edge : tc * edge + edge + 2 * halo]
                        rows += [(image, ch, tr, tc, h, w, lo - (tr * edge - halo), hi - lo, np.ascontiguousarray(part[:, :, ch]).tobytes()) for ch in range(channels)]
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int32()) for c in cols[1:8]), pa.array(cols[8], pa.binary())], names)

    pieces = bands.select("image_id", "r0", "height", "width", "channels", "data").mapInArrow(cut, piece)
    grouped = pieces.groupBy("image_id", "channel", "tr", "tc", "h", "w").agg(F.collect_list(F.struct("top", "rows", "data")).alias("parts"))
    wide = edge + 2 * halo

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image, channel, tr, tc, h, w = (batch.column(j)[k].as_py() for j in range(6))
                data = np.zeros((wide, wide), np.uint8)
                for p in batch.column(6)[k]:
                    top, rows = p["top"].as_py(), p["rows"].as_py()
                    data[top : top + rows] = np.frombuffer(p["data"].as_buffer(), np.uint8).reshape(rows, wide)
                yield _tile(image, channel, tr * edge, tc * edge, min(edge, h - tr * edge), min(edge, w - tc * edge), halo, h, w, data, edge)

    return grouped.mapInArrow(join, TILE)


def point_values(data: np.ndarray, r0: int, c0: int, th: int, tw: int, halo: int, run: Run) -> Iterator[np.ndarray]:
    """The bilinear values of each point, in order, for all of a tile's own pixels.

    Horizontal values are taken once for each row and then mixed down the rows: the same products and sums in the same
    order as for a single pixel.
    """
    image = data.astype(np.float64)
    r, c = np.arange(r0, r0 + th, dtype=np.float64), np.arange(c0, c0 + tw, dtype=np.float64)
    for dy, dx in offsets(run):
        y, x = r + dy, c + dx
        y0, x0 = np.floor(y), np.floor(x)
        a, b = (y - y0)[:, None], (x - x0)[None, :]
        up, down = (y0 - r0 + halo).astype(np.intp), (np.ceil(y) - r0 + halo).astype(np.intp)
        left, right = (x0 - c0 + halo).astype(np.intp), (np.ceil(x) - c0 + halo).astype(np.intp)
        lo, hi = up.min(), down.max() + 1
        rows = image[lo:hi]
        across = (1 - b) * rows[:, left] + b * rows[:, right]
        yield (1 - a) * across[up - lo] + a * across[down - lo]


def tile_codes(data: np.ndarray, r0: int, c0: int, th: int, tw: int, halo: int, run: Run, method: str = "uniform") -> np.ndarray:
    """Codes of a tile's own pixels, in memory of a few tiles for any number of points."""
    values = point_values(data, r0, c0, th, tw, halo, run)
    n = run.npoints
    if method == "var":
        total, squares = np.zeros((th, tw)), np.zeros((th, tw))
        for t in values:
            total += t
            squares += t * t
        out = (squares - total * total / n) / n
        out[out == 0] = np.nan
        return out
    centre = data[halo : halo + th, halo : halo + tw].astype(np.float64)
    ones, changes = np.zeros((th, tw), np.int32), np.zeros((th, tw), np.int32)
    bits = np.zeros((th, tw), np.int64)
    first = np.full((2, th, tw), n, np.int32)  # of the first point that is 0, and that is 1
    before = starts = None
    for i, t in enumerate(values):
        s = t - centre >= 0
        ones += s
        if method in ("default", "ror"):
            bits |= s.astype(np.int64) << i
        elif method == "nri_uniform":
            for bit in (0, 1):
                np.minimum(first[bit], np.where(s == bool(bit), i, n), out=first[bit])
        if before is None:
            starts = s
        else:
            changes += s != before
        before = s
    if method == "default":
        return bits
    if method == "ror":
        least = bits.copy()
        for _ in range(n - 1):
            bits = (bits >> 1) | ((bits & 1) << (n - 1))
            np.minimum(least, bits, out=least)
        return least
    if method == "uniform":
        return np.where(changes <= 2, ones, n + 1)
    turn = np.where(starts, ones - first[0], n - first[1])
    out = np.where(changes > 2, n * (n - 1) + 2, 1 + (ones - 1) * n + turn)
    return np.where(ones == 0, 0, np.where(ones == n, n * (n - 1) + 1, out))


#: Types of the codes by method, in SQL.
CODE = {"default": "bigint", "ror": "bigint", "uniform": "int", "nri_uniform": "int", "var": "double"}


def pixel_codes(tiles: DataFrame, of: Sequence[Run], method: str = "uniform") -> DataFrame:
    """image_id, channel, radius_idx, r, c and code of every pixel.

    Tiles may have ``gate``, whether masks apply, ``on``, one byte a pixel, and ``patches``, included patches of ``edge`` pixels
    (patch_r, patch_c, edge): other pixels have code 0, and a tile without any is not computed.
    """
    gated = "gate" in tiles.columns
    if gated:
        tiles = tiles.select(*[f.split()[0] for f in TILE.split(", ")], "on", "patches")
    kind = {"bigint": np.int64, "int": np.int32, "double": np.float64}[CODE[method]]

    def allowed(batch: pa.RecordBatch, k: int, r0: int, c0: int, th: int, tw: int) -> np.ndarray | None:
        if not gated:
            return None
        out = np.zeros((th, tw), bool)
        if batch.column(10)[k].is_valid:
            out = np.frombuffer(batch.column(10)[k].as_buffer(), np.uint8).reshape(th, tw) != 0
        elif batch.column(11)[k].is_valid:
            for p in batch.column(11)[k].as_py():
                a, b, e = p["patch_r"] * p["edge"] - r0, p["patch_c"] * p["edge"] - c0, p["edge"]
                out[a : a + e, b : b + e] = True
        return out

    def run_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image, channel, r0, c0, th, tw, halo, h, w = (batch.column(j)[k].as_py() for j in range(9))
                data = np.frombuffer(batch.column(9)[k].as_buffer(), np.uint8).reshape(th + 2 * halo, tw + 2 * halo)
                on = allowed(batch, k, r0, c0, th, tw)
                rows, cols = (x.ravel().astype(np.int32) for x in np.mgrid[r0 : r0 + th, c0 : c0 + tw])
                n = rows.size
                for run in of:
                    if on is not None and not on.any():
                        codes = np.zeros(n, kind)
                    else:
                        codes = tile_codes(data, r0, c0, th, tw, halo, run, method).astype(kind)
                        codes = (codes if on is None else np.where(on, codes, kind(0))).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([image] * n, pa.string()), pa.array(np.full(n, channel, np.int32)), pa.array(np.full(n, run.index, np.int32)), pa.array(rows), pa.array(cols), pa.array(codes)],
                        ["image_id", "channel", "radius_idx", "r", "c", "code"],
                    )

    return tiles.mapInArrow(run_tiles, f"image_id string, channel int, radius_idx int, r int, c int, code {CODE[method]}")


def histograms(tiles: DataFrame, of: Sequence[Run], patch_size: int) -> DataFrame:
    """Dense histograms (npoints + 2 counts) of each complete patch, channel and run.

    Tiles may have ``patches``, those that are included: the others have zeros.
    """
    gated = "patches" in tiles.columns
    names = [f.split()[0] for f in HISTOGRAM.split(", ")]

    def run_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image, channel, r0, c0, th, tw, halo, h, w = (batch.column(j)[k].as_py() for j in range(9))
                nr, nc = th // patch_size, tw // patch_size
                if not nr or not nc:
                    continue
                data = np.frombuffer(batch.column(9)[k].as_buffer(), np.uint8).reshape(th + 2 * halo, tw + 2 * halo)
                n = nr * nc
                kept = np.ones(n, bool)
                if gated:
                    kept[:] = False
                    kept[[(p["patch_r"] - r0 // patch_size) * nc + p["patch_c"] - c0 // patch_size for p in batch.column(10)[k].as_py()]] = True
                patch = (np.repeat(np.arange(nr), patch_size)[:, None] * nc + np.repeat(np.arange(nc), patch_size)[None, :]).astype(np.int64)
                for run in of:
                    codes = tile_codes(data, r0, c0, nr * patch_size, nc * patch_size, halo, run)
                    counts = np.bincount((patch * run.bins + codes).ravel(), minlength=n * run.bins).reshape(n, run.bins)
                    counts = np.where(kept[:, None], counts, 0).ravel()
                    where = pa.array(np.arange(0, counts.size + 1, run.bins, dtype=np.int32))
                    at_r, at_c = np.divmod(np.arange(n), nc)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([image] * n, pa.string()),
                            pa.array(np.full(n, channel, np.int32)),
                            pa.array(np.full(n, run.index, np.int32)),
                            pa.array((at_r + r0 // patch_size).astype(np.int32)),
                            pa.array((at_c + c0 // patch_size).astype(np.int32)),
                            pa.ListArray.from_arrays(where, pa.array(counts.astype(np.int64))),
                        ],
                        names,
                    )

    return tiles.mapInArrow(run_tiles, HISTOGRAM)


def included_by_tile(patch_mask: DataFrame, edge: int, patch_size: int) -> DataFrame:
    """image_id, r0, c0 and patches (patch_r, patch_c, edge) of the tiles that have an included patch."""
    per = edge // patch_size
    on = patch_mask.filter("included <> 0").select("image_id", F.expr(f"(patch_r div {per}) * {edge}").cast("int").alias("r0"), F.expr(f"(patch_c div {per}) * {edge}").cast("int").alias("c0"), F.struct("patch_r", "patch_c", F.lit(patch_size).alias("edge")).alias("p"))
    return on.groupBy("image_id", "r0", "c0").agg(F.collect_list("p").alias("patches"))  # at most per * per


def masked_tiles(tiles: DataFrame, patch_mask: DataFrame, edge: int, patch_size: int) -> DataFrame:
    """The tiles that have an included patch, with a list of these patches."""
    return tiles.join(included_by_tile(patch_mask, edge, patch_size), ["image_id", "r0", "c0"]).select(*tiles.columns, "patches")
