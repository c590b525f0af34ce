"""DuckDB SQL for the texture queries, written from the definitions: neighbours by equi-joins, not by arrays."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.params import Run
from ..operators.borders import MODES
from .queries import ALL_RADII, EIGHT, LADDER, PATCH_SIZE, R1, SMALL

EMB = """px AS (SELECT 'embeddings' AS image_id, 0 AS channel, CAST(vec_id AS INTEGER) AS r, CAST(i - 1 AS INTEGER) AS c,
  CAST(floor((CAST(embedding[i] AS DOUBLE) + 1.0) * 127.5) AS INTEGER) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
LINE = """cell AS (SELECT CAST(l_orderkey AS INTEGER) AS r, CAST(l_linenumber - 1 AS INTEGER) AS c, max(CAST(l_quantity AS INTEGER)) AS v0,
  max(CAST(round(l_discount * 100) AS INTEGER)) AS v1, max(CAST(round(l_tax * 100) AS INTEGER)) AS v2 FROM lineitem GROUP BY ALL),
px AS (SELECT 'lineitem' AS image_id, CAST(k.k AS INTEGER) AS channel, CAST(a.r AS INTEGER) AS r, CAST(b.c AS INTEGER) AS c,
  coalesce(CASE k.k WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END, 0) AS v
  FROM range((SELECT max(l_orderkey) + 1 FROM lineitem)) a(r) CROSS JOIN range(7) b(c) CROSS JOIN range(3) k(k) LEFT JOIN cell ON cell.r = a.r AND cell.c = b.c)"""
BRIGHT = "m AS (SELECT image_id, r, c, greatest(v - 124, 0) AS m FROM px)"
RIGHT = "m AS (SELECT image_id, r, c, CAST(c >= 32 AS INTEGER) AS m FROM px)"


def runs_sql(of: Sequence[Run]) -> str:
    rows = ", ".join(f"({r.index}, CAST({r.radius} AS DOUBLE), {r.npoints}, {r.offset}, '{r.label}')" for r in of)
    return f"runs AS (SELECT * FROM (VALUES {rows}) t(k, radius, p, first, label))"


def samples_sql(of: Sequence[Run]) -> str:
    """All bilinear samples: each corner is a left join, so what is outside of the image is 0."""
    corners = "\n".join(
        f"  LEFT JOIN px {n} ON {n}.image_id = q.image_id AND {n}.channel = q.channel AND {n}.r = q.{y} AND {n}.c = q.{x}" for n, y, x in (("tl", "y0", "x0"), ("tr", "y0", "x1"), ("bl", "y1", "x0"), ("br", "y1", "x1"))
    )
    return f"""{runs_sql(of)},
o AS (SELECT k, p, i, round(-radius * sin(2 * pi() * i / p), 5) AS dy, round(radius * cos(2 * pi() * i / p), 5) AS dx FROM (SELECT *, unnest(range(p)) AS i FROM runs)),
q AS (SELECT *, CAST(floor(y) AS INTEGER) AS y0, CAST(ceil(y) AS INTEGER) AS y1, CAST(floor(x) AS INTEGER) AS x0, CAST(ceil(x) AS INTEGER) AS x1, y - floor(y) AS a, x - floor(x) AS b
  FROM (SELECT px.*, o.k, o.p, o.i, px.r + o.dy AS y, px.c + o.dx AS x FROM px, o)),
s AS (SELECT q.image_id, q.channel, q.r, q.c, q.v, q.k, q.p, q.i,
  (1 - a) * ((1 - b) * coalesce(tl.v, 0) + b * coalesce(tr.v, 0)) + a * ((1 - b) * coalesce(bl.v, 0) + b * coalesce(br.v, 0)) AS t FROM q
{corners})"""


def bits_sql(of: Sequence[Run]) -> str:
    return f"""{samples_sql(of)},
b AS (SELECT image_id, channel, r, c, k, p, CAST(sum(one) AS INTEGER) AS ones, list(one ORDER BY i) AS l FROM (SELECT *, CASE WHEN t - v >= 0 THEN 1 ELSE 0 END AS one FROM s) GROUP BY ALL),
u AS (SELECT *, len(list_filter(range(1, p), lambda j: l[j] <> l[j + 1])) AS steps FROM b)"""


def codes_sql(of: Sequence[Run], method: str = "uniform") -> str:
    number = "list_sum(list_transform(range(p), lambda j: l[j + 1] * (1::BIGINT << j)))"
    code = {
        "uniform": "CAST(CASE WHEN steps <= 2 THEN ones ELSE p + 1 END AS INTEGER)",
        "default": f"CAST({number} AS BIGINT)",
        "ror": "CAST(list_min(list_transform(range(p), lambda z: list_sum(list_transform(range(p), lambda j: l[((j + z) % p) + 1] * (1::BIGINT << j))))) AS BIGINT)",
        "nri_uniform": "CAST(CASE WHEN ones = 0 THEN 0 WHEN ones = p THEN p * (p - 1) + 1 WHEN steps > 2 THEN p * (p - 1) + 2 "
        "ELSE 1 + (ones - 1) * p + CASE WHEN l[1] = 1 THEN ones - (list_position(l, 0) - 1) ELSE p - (list_position(l, 1) - 1) END END AS INTEGER)",
    }[method]
    return f"{bits_sql(of)},\ncode AS (SELECT image_id, channel, k AS radius_idx, r, c, {code} AS code FROM u)"


SIZE = "size AS (SELECT image_id, max(r) + 1 AS h, max(c) + 1 AS w, max(channel) + 1 AS channels FROM px GROUP BY image_id)"


def patches_sql(ps: int) -> str:
    return f"""{SIZE},
patch AS (SELECT image_id, CAST(a AS INTEGER) AS patch_r, CAST(b AS INTEGER) AS patch_c FROM (SELECT image_id, a, unnest(range(w // {ps})) AS b FROM (SELECT *, unnest(range(h // {ps})) AS a FROM size)))"""


def patch_mask_sql(ps: int, method: str) -> str:
    test = "max(CASE WHEN m <> 0 THEN 1 ELSE 0 END)" if method == "any" else "min(CASE WHEN m <> 0 THEN 1 ELSE 0 END)"
    return f"pm AS (SELECT image_id, CAST(r // {ps} AS INTEGER) AS patch_r, CAST(c // {ps} AS INTEGER) AS patch_c, {test} AS included, min(CASE WHEN m <> 0 THEN 1 ELSE 0 END) AS whole FROM m GROUP BY ALL HAVING count(*) = {ps * ps})"


def histogram_sql(ps: int) -> str:
    return f"""hist AS (SELECT code.image_id, channel, radius_idx, CAST(r // {ps} AS INTEGER) AS patch_r, CAST(c // {ps} AS INTEGER) AS patch_c, code AS lbp_code, count(*) AS count
  FROM code JOIN patch ON patch.image_id = code.image_id AND patch_r = r // {ps} AND patch_c = c // {ps} GROUP BY ALL)"""


def features_sql(of: Sequence[Run], px: str, ps: int, mask: str = "") -> str:
    per = sum(r.bins for r in of)
    on = " AND EXISTS (SELECT 1 FROM pm WHERE pm.image_id = f.image_id AND pm.patch_r = f.patch_r AND pm.patch_c = f.patch_c AND included = 1)" if mask else ""
    return f"""WITH {px},
{mask and mask + ","}
{codes_sql(of)},
{patches_sql(ps)},
{histogram_sql(ps)},
f AS (SELECT patch.*, CAST(ch AS INTEGER) AS channel, runs.k AS radius_idx, CAST(j AS INTEGER) AS lbp_code, CAST(ch * {per} + first + j AS INTEGER) AS feature_number
  FROM patch JOIN size USING (image_id) CROSS JOIN (SELECT *, unnest(range(p + 2)) AS j FROM runs) runs CROSS JOIN range((SELECT max(channels) FROM size)) c(ch)),
long AS (SELECT f.image_id, f.patch_r, f.patch_c, f.channel, f.radius_idx, f.lbp_code, f.feature_number, CAST(coalesce(hist.count, 0) AS BIGINT) AS count
  FROM f LEFT JOIN hist ON hist.image_id = f.image_id AND hist.patch_r = f.patch_r AND hist.patch_c = f.patch_c AND hist.channel = f.channel AND hist.radius_idx = f.radius_idx AND hist.lbp_code = f.lbp_code{on})"""


FIFTH = "CASE WHEN j = p + 1 THEN 5 WHEN j <= p // 5 THEN 0 WHEN j <= 2 * p // 5 THEN 1 WHEN j <= 3 * p // 5 THEN 2 WHEN j <= 4 * p // 5 THEN 3 ELSE 4 END"
NAMES = {"reduced": "['flat_lo', 'corner_lo', 'edge', 'corner_hi', 'flat_hi', 'nonuniform']", "minimal": "['flat', 'corner', 'edge', 'nonuniform']"}


def groups_sql(of: Sequence[Run], method: str) -> str:
    """One row a run and code: its group, and where the run begins before and after merging."""
    group = FIFTH if method == "reduced" else f"([0, 1, 2, 1, 0, 3])[({FIFTH}) + 1]"
    size = len(NAMES[method].split(","))
    return f"""{runs_sql(of)},
r2 AS (SELECT *, coalesce(sum(CASE WHEN p + 2 < 12 THEN p + 2 ELSE {size} END) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_first,
  sum(CASE WHEN p + 2 < 12 THEN p + 2 ELSE {size} END) OVER () AS new_per, sum(p + 2) OVER () AS per FROM runs),
g AS (SELECT k, radius, p, label, first, new_first, new_per, per, CAST(j AS INTEGER) AS j, CAST(CASE WHEN p + 2 < 12 THEN j ELSE {group} END AS INTEGER) AS g,
  CASE WHEN p + 2 >= 12 THEN ({NAMES[method]})[{group} + 1] END AS name FROM (SELECT *, unnest(range(p + 2)) AS j FROM r2))"""


def _groups(method: str) -> str:
    return f"WITH {groups_sql(ALL_RADII, method)} SELECT DISTINCT p AS npoints, j AS lbp_code, g AS group_idx, name AS group_name FROM g"


def _reduced_dictionary(method: str) -> str:
    return f"""WITH {groups_sql(LADDER, method)}, d AS (SELECT DISTINCT CAST(ch AS INTEGER) AS channel, radius, p, label, g, name, CAST(ch * new_per + new_first + g AS INTEGER) AS n FROM g, range(3) c(ch))
SELECT n AS feature_number, channel, radius, p AS npoints, CASE WHEN name IS NULL THEN g END AS lbp_code, name AS lbp_code_type,
  n || '_ch' || channel || '_r' || label || '_p' || p || '_lbp' || coalesce('_' || name, CAST(g AS VARCHAR)) AS label FROM d"""


def _reduced(method: str) -> str:
    return f"""{features_sql(LADDER, EMB, PATCH_SIZE)},
{groups_sql(LADDER, method).split("," + chr(10), 1)[1]}
SELECT image_id, patch_r, patch_c, CAST(channel * new_per + new_first + g AS INTEGER) AS feature_number, CAST(sum(count) AS BIGINT) AS count
FROM long JOIN g ON g.k = radius_idx AND g.j = lbp_code GROUP BY ALL"""


def _dictionary() -> str:
    per = sum(r.bins for r in LADDER)
    return f"""WITH {runs_sql(LADDER)}, d AS (SELECT CAST(ch AS INTEGER) AS channel, radius, p, label, CAST(j AS INTEGER) AS j, CAST(ch * {per} + first + j AS INTEGER) AS n FROM (SELECT *, unnest(range(p + 2)) AS j FROM runs), range(3) c(ch))
SELECT n AS feature_number, channel, radius, p AS npoints, j AS lbp_code, n || '_ch' || channel || '_r' || label || '_p' || p || '_lbp' || j AS label FROM d"""


def _jobs(columns: str) -> str:
    per = sum(r.bins for r in LADDER)
    return f"""WITH {runs_sql(LADDER)}, j AS (SELECT CAST(ch AS INTEGER) AS channel, k AS radius_idx, radius, p AS npoints, p + 2 AS nfeatures, CAST(ch * {per} + first AS INTEGER) AS output_offset, {3 * per} AS total_nfeatures,
  CAST(row_number() OVER (ORDER BY radius DESC, ch DESC) AS INTEGER) AS job_rank FROM runs, range(3) c(ch)) SELECT {columns} FROM j"""


def _edit(method: str) -> str:
    return f"""WITH {EMB}, {BRIGHT}, {patch_mask_sql(3, method)}
SELECT m.image_id, m.r, m.c, CAST(CASE WHEN pm.whole IS NULL OR pm.whole = 1 THEN m.m ELSE pm.included END AS INTEGER) AS m
FROM m LEFT JOIN pm ON pm.image_id = m.image_id AND pm.patch_r = m.r // 3 AND pm.patch_c = m.c // 3"""


def _codes(of: Sequence[Run], method: str = "uniform") -> str:
    return f"WITH {EMB}, {codes_sql(of, method)} SELECT * FROM code"


def _modes() -> str:
    k2, k1 = "((pos % (2 * size)) + 2 * size) % (2 * size)", "((pos % greatest(2 * size - 2, 1)) + greatest(2 * size - 2, 1)) % greatest(2 * size - 2, 1)"
    by = {
        "constant": "CASE WHEN pos BETWEEN 0 AND size - 1 THEN pos END",
        "edge": "CASE WHEN pos < 0 THEN 0 WHEN pos > size - 1 THEN size - 1 ELSE pos END",
        "wrap": "((pos % size) + size) % size",
        "symmetric": f"CASE WHEN {k2} < size THEN {k2} ELSE 2 * size - 1 - {k2} END",
        "reflect": f"CASE WHEN size = 1 THEN 0 WHEN {k1} < size THEN {k1} ELSE 2 * size - 2 - {k1} END",
    }
    return f"SELECT CAST(size AS INTEGER) AS size, CAST(pos AS INTEGER) AS pos, {', '.join(f'CAST({by[m]} AS INTEGER) AS {m}' for m in MODES)} FROM range(1, 7) s(size), range(-14, 15) a(pos)"


_NOISE = "CAST(((CAST(r AS BIGINT) * 1103515245 + CAST(c AS BIGINT) * 1664525 + CAST(r AS BIGINT) * c * 22695477 + CAST(ch AS BIGINT) * 2654435761) // 65536) % 256 AS INTEGER)"
_FEATURES = "SELECT image_id, patch_r, patch_c, channel, radius_idx, lbp_code, feature_number, count FROM long"

ORACLES: dict[str, str] = {
    "radii_ladder": "SELECT CAST(x AS INTEGER) AS radius_idx, CAST(round(1.499 * pow(1.327, x)) AS INTEGER) AS radius FROM range(15) t(x)",
    "npoints_ladder": "SELECT CAST(x AS INTEGER) AS radius_idx, CAST(round(1.499 * pow(1.327, x)) AS INTEGER) AS radius, CAST(ceil(2 * pi() * round(1.499 * pow(1.327, x))) AS INTEGER) AS npoints FROM range(15) t(x)",
    "neighbour_offsets": f"WITH {runs_sql(ALL_RADII)} SELECT k AS radius_idx, CAST(i AS INTEGER) AS i, round(-radius * sin(2 * pi() * i / p), 5) + 0.0::DOUBLE AS dy, round(radius * cos(2 * pi() * i / p), 5) + 0.0::DOUBLE AS dx FROM (SELECT *, unnest(range(p)) AS i FROM runs)",
    "feature_dictionary": _dictionary(),
    "feature_lookup": f"SELECT * FROM ({_dictionary()}) WHERE feature_number = 200",
    "feature_dictionary_reduced": _reduced_dictionary("reduced"),
    "feature_dictionary_minimal": _reduced_dictionary("minimal"),
    "code_groups_reduced": _groups("reduced"),
    "code_groups_minimal": _groups("minimal"),
    "reduction_map": f"WITH {groups_sql(LADDER, 'reduced')} SELECT CAST(ch * per + first + j AS INTEGER) AS feature_number, CAST(ch * new_per + new_first + g AS INTEGER) AS new_feature_number FROM g, range(3) c(ch)",
    "pixels_embeddings": f"WITH {EMB} SELECT * FROM px",
    "pixels_lineitem": f"WITH {LINE} SELECT * FROM px",
    "pixels_events": """WITH e AS (SELECT CAST(user_id AS INTEGER) AS r, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INTEGER) AS c, CAST(least(255, 60 * count(*)) AS INTEGER) AS v FROM events GROUP BY ALL)
SELECT 'events' AS image_id, 0 AS channel, CAST(a.r AS INTEGER) AS r, CAST(b.c AS INTEGER) AS c, coalesce(v, 0) AS v FROM range((SELECT max(r) + 1 FROM e)) a(r) CROSS JOIN range((SELECT max(c) + 1 FROM e)) b(c) LEFT JOIN e ON e.r = a.r AND e.c = b.c""",
    "pixels_synthetic": f"""SELECT kind AS image_id, CAST(ch AS INTEGER) AS channel, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CASE WHEN kind = 'synthetic_noise' THEN {_NOISE} ELSE CAST((3 * r + 5 * c + 17 * ch) % 256 AS INTEGER) END AS v
FROM range(97) a(r), range(61) b(c), range(3) k(ch), (VALUES ('synthetic_noise'), ('synthetic_ramp')) t(kind)""",
    "patch_extract": f"WITH {EMB} SELECT * FROM px WHERE r // {PATCH_SIZE} = 3 AND c // {PATCH_SIZE} = 2",
    "patch_mask_any": f"WITH {EMB}, {BRIGHT}, {patch_mask_sql(2, 'any')} SELECT image_id, patch_r, patch_c, included FROM pm",
    "patch_mask_all": f"WITH {EMB}, {BRIGHT}, {patch_mask_sql(2, 'all')} SELECT image_id, patch_r, patch_c, included FROM pm",
    "mask_edit_any": _edit("any"),
    "mask_edit_all": _edit("all"),
    "bilinear_samples": f"WITH {EMB}, {samples_sql(R1)} SELECT image_id, channel, k AS radius_idx, r, c, CAST(i AS INTEGER) AS i, CAST(floor(t * 1e6::DOUBLE) AS BIGINT) AS t_micro FROM s",
    "lbp_uniform_r1": _codes(LADDER[:1]),
    "lbp_uniform_r2": _codes(LADDER[1:2]),
    "lbp_uniform_r3": _codes(LADDER[2:3]),
    "lbp_uniform_pixel_masked": f"WITH {EMB}, {BRIGHT}, {codes_sql(R1)} SELECT code.image_id, channel, radius_idx, code.r, code.c, CASE WHEN m.m <> 0 THEN code ELSE 0 END AS code FROM code JOIN m ON m.image_id = code.image_id AND m.r = code.r AND m.c = code.c",
    "lbp_uniform_patch_masked": f"WITH {EMB}, {BRIGHT}, {patch_mask_sql(2, 'all')}, {codes_sql(R1)} SELECT code.image_id, channel, radius_idx, r, c, CASE WHEN included = 1 THEN code ELSE 0 END AS code FROM code LEFT JOIN pm ON pm.image_id = code.image_id AND patch_r = r // 2 AND patch_c = c // 2",
    "lbp_default": _codes(EIGHT, "default"),
    "lbp_ror": _codes(EIGHT, "ror"),
    "lbp_nri_uniform": _codes(EIGHT, "nri_uniform"),
    "lbp_var": f"""WITH {EMB}, {samples_sql(EIGHT)}, l AS (SELECT image_id, channel, k, r, c, list(t ORDER BY i) AS t FROM s GROUP BY ALL),
z AS (SELECT *, list_reduce(t, lambda a, b: a + b) AS s1, list_reduce(list_transform(t, lambda a: a * a), lambda a, b: a + b) AS s2 FROM l)
SELECT image_id, channel, k AS radius_idx, r, c, CAST(floor(nullif((s2 - s1 * s1 / len(t)) / len(t), 0) * 1e6::DOUBLE) AS BIGINT) AS code_micro FROM z""",
    "patch_histogram": f"WITH {EMB}, {codes_sql(R1)}, {patches_sql(PATCH_SIZE)}, {histogram_sql(PATCH_SIZE)} SELECT * FROM hist",
    "patch_histogram_masked": f"WITH {EMB}, {RIGHT}, {patch_mask_sql(PATCH_SIZE, 'any')}, {codes_sql(R1)}, {patches_sql(PATCH_SIZE)}, {histogram_sql(PATCH_SIZE)} SELECT hist.* FROM hist JOIN pm USING (image_id, patch_r, patch_c) WHERE included = 1",
    "lbp_features_r1": f"{features_sql(R1, EMB, PATCH_SIZE)} {_FEATURES}",
    "lbp_features_long": f"{features_sql(LADDER, EMB, PATCH_SIZE)} {_FEATURES}",
    "lbp_features_tiled": f"{features_sql(LADDER, EMB, PATCH_SIZE)} {_FEATURES}",
    "lbp_features_masked": f"{features_sql(R1, EMB, PATCH_SIZE, RIGHT + ', ' + patch_mask_sql(PATCH_SIZE, 'any'))} {_FEATURES}",
    "lbp_features_multichannel": f"{features_sql(SMALL, LINE, 7)} {_FEATURES}",
    "reduce_features_reduced": _reduced("reduced"),
    "reduce_features_minimal": _reduced("minimal"),
    "jobs_manifest": _jobs("* EXCLUDE (job_rank)"),
    "jobs_longest_first": _jobs("channel, radius_idx, radius, npoints, job_rank"),
    "rect_sum_integral": f"""WITH {EMB}, {SIZE}, q AS (SELECT px.image_id, channel, r AS r0, c AS c0, least(r + 8, h - 1) AS r1, least(c + 16, w - 1) AS c1 FROM px JOIN size USING (image_id)),
cell AS (SELECT q.*, y, unnest(range(c0, c1 + 1)) AS x FROM (SELECT *, unnest(range(r0, r1 + 1)) AS y FROM q) q)
SELECT q.image_id, q.channel, r0, c0, r1, c1, CAST(sum(v) AS BIGINT) AS total FROM cell q JOIN px ON px.image_id = q.image_id AND px.channel = q.channel AND px.r = y AND px.c = x GROUP BY ALL""",
    "lbp_features_masked_tiled": f"{features_sql(R1, EMB, PATCH_SIZE, RIGHT + ', ' + patch_mask_sql(PATCH_SIZE, 'any'))} {_FEATURES}",
    "lbp_features_vector": f"{features_sql(LADDER, EMB, PATCH_SIZE)} SELECT image_id, patch_r, patch_c, string_agg(CAST(count AS VARCHAR), ',' ORDER BY feature_number) AS features FROM long GROUP BY ALL",
    "reduce_vectors_reduced": f"SELECT image_id, patch_r, patch_c, string_agg(CAST(count AS VARCHAR), ',' ORDER BY feature_number) AS features FROM ({_reduced('reduced')}) GROUP BY ALL",
    "image_names": "SELECT page_id, translate(url, '.-', '__') AS image_name, translate(url, '.-', '__') || '.npy' AS file_name FROM pages",
    "jobs_complete": f"SELECT count(*) AS n_jobs, count(*) - count(channel + radius_idx + radius + npoints + nfeatures + output_offset + total_nfeatures + job_rank) AS n_incomplete FROM ({_jobs('*')})",
    "border_modes": _modes(),
}
ORACLES |= {f"{name}_tiled": ORACLES[name] for name in ("lbp_default", "lbp_ror", "lbp_nri_uniform", "lbp_var", "lbp_uniform_r3", "lbp_uniform_pixel_masked", "lbp_uniform_patch_masked")}
