"""Operators with known answers and edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazo.functions import arrays as K
from terrazo.functions import polygons as G
from terrazo.functions import scalars as S
from terrazo.operators import analytics as A
from terrazo.operators import composite as C
from terrazo.operators import parcels as PC
from terrazo.operators import spatial as P
from terrazo.operators import warp as W
from terrazo.sources import files as IO
from terrazo.sources import geofiles as IO2


def test_to_db(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (-3.0,), (None,)], "v double")
    assert [r[0] for r in d.select(S.to_db(F.col("v"))).collect()] == [None, 0.0, 10.0, None, None]


def test_robust_z_edges(spark):
    rows = [("few", float(i)) for i in range(9)] + [("flat", 5.0)] * 12 + [("ok", float(i)) for i in range(11)] + [("ok", 1e9), ("ok", None)]
    out = A.robust_z(spark.createDataFrame(rows, "g string, v double"), "v", "z", ["g"]).collect()
    assert all(r["z"] == 0 for r in out if r["g"] != "ok")
    assert max(r["z"] for r in out) == 4 and next(r["z"] for r in out if r["v"] is None) == 0


def test_rank_ties_and_nulls(spark):
    d = spark.createDataFrame([(1,), (1,), (3,), (None,)], "v int").select("v", A.avg_rank("v").alias("k"))
    assert sorted((str(r[0]), r[1]) for r in d.collect()) == [("1", 1.5), ("1", 1.5), ("3", 3.0), ("None", None)]


def test_kappa_pe_one(spark):
    assert A.kappa(spark.createDataFrame([("x", "x")] * 3, "a string, b string"), "a", "b").first()["kappa"] is None


def test_argmax_first_and_softmax(spark):
    d = spark.createDataFrame([([1.0, 1.0, 0.0],), ([float("nan"), 2.0, None],)], "e array<double>")
    out = d.select(S.argmax_label(S.softmax(F.col("e")), ["a", "b", "c"]).alias("l"), F.aggregate(S.softmax(F.col("e")), F.lit(0.0), lambda x, y: x + y).alias("s")).collect()
    assert [r["l"] for r in out] == ["a", "b"] and all(abs(r["s"] - 1) < 1e-12 for r in out)


def test_normal_cdf(spark):
    z = [-3.0, -1.0, 0.0, 0.5, 2.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(S.normal_cdf(F.col("z"))).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-x / math.sqrt(2)) for x in z], atol=2e-7)


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    xy = np.vstack([rng.normal(size=(120, 2)), [[50, 50], [-80, 3]], np.zeros((5, 2))])
    d = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    got = {(r["src"], r["rank"]): r["dst"] for r in P.knn(d, 4, 0.5).collect()}
    for i, p in enumerate(xy):
        order = sorted((float((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2), j) for j, q in enumerate(xy) if j != i)
        assert [got[i, k + 1] for k in range(4)] == [j for _, j in order[:4]]


def test_centroid_degenerate_and_multipart(spark):
    rows = [(1, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2)])] + [(1, 1, i, float(x), float(y)) for i, (x, y) in enumerate([(10, 0), (10, 2), (12, 2), (12, 0)])]
    rows += [(2, 0, 0, 1.0, 1.0), (2, 0, 1, 3.0, 1.0)]
    out = {r["id"]: (r["area"], r["cx"], r["cy"]) for r in P.shoelace_centroid(spark.createDataFrame(rows, "id int, part int, seq int, x double, y double")).collect()}
    assert out[1] == pytest.approx((8, 6, 1)) and out[2] == pytest.approx((0, 2, 1))


def test_fit_prior_reaches_shares():
    rng = np.random.default_rng(0)
    p = rng.dirichlet([1, 1, 1], 3000)
    prior = np.array([0.6, 0.3, 0.1])
    b = C.solve_prior(np.log(p), prior, np.ones(3000))
    share = np.bincount((np.log(p) + b).argmax(1), minlength=3) / 3000
    assert np.abs(share - prior).max() < 0.005 and abs(b.mean()) < 1e-12


def test_icm_energy_does_not_rise():
    rng = np.random.default_rng(2)
    u, near = rng.normal(size=(200, 3)), rng.integers(0, 200, (200, 4))
    w = np.ones((200, 4))

    def agree(x):
        return (x[near] == x[:, None]).sum()

    assert agree(C.icm(u, near, w, 2.0)) > agree(u.argmax(1))


def test_wcm_round_trip():
    soil = np.full(4, 0.1)
    turn = K.wcm_turning(0.3, 0.4, soil, 35.0)[0]
    v = np.array([turn + 0.5, turn + 2, turn + 1, turn + 3])
    root, flag = K.wcm_invert(K.wcm_power(v, 0.3, 0.4, soil, 35.0), 0.3, 0.4, soil, 35.0)
    assert np.allclose(root, v, atol=1e-3)
    power = np.array([np.nan, 0.0, -1.0, 1e9])
    assert K.wcm_invert(power, 0.3, 0.4, soil, 35.0)[1].tolist() == ["nan", "nan", "nan", "sat"]


def test_glcm_entropy_of_stripes():
    stripes = np.tile([1.0, 2.0], (8, 4))
    inside = np.ones(stripes.shape, bool)
    # Rows, and both diagonals, change level at each step (two equal cells of the matrix); columns keep theirs (two as well).
    assert abs(K.glcm_entropy(stripes, inside) - np.log(2)) < 1e-9
    assert np.isnan(K.glcm_entropy(stripes, np.eye(8, dtype=bool)))
    assert np.isnan(K.glcm_entropy(stripes, np.tile([True, False], (8, 4))))
    # Levels come from the whole image: a flat parcel in it has one level.
    wide = np.hstack([stripes, np.full((8, 8), 5.0)])
    assert K.glcm_entropy(wide, wide == 5.0) == 0


def test_coherence_and_offset():
    rng = np.random.default_rng(3)
    z, o = (rng.normal(size=(96, 96)) + 1j * rng.normal(size=(96, 96)) for _ in range(2))
    assert K.coherence(z, z).mean() > 0.99 and 0 < K.coherence(z, o).mean() < 0.3
    assert K.offset(z, K.fourier_shift(z, 3, -5)) == pytest.approx((3, -5), abs=0.2)


def test_student_p():
    assert K.student_p(0.5, 20) == pytest.approx(0.0247, abs=5e-4) and K.student_p(1.0, 9) == 0.0 and math.isnan(K.student_p(0.1, 2))


def test_csv_nan_and_ledger(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,NaN\n2,\n3,4.5\n")
    assert sorted((r[0], r[1]) for r in IO.read_csv(spark, str(tmp_path / "a.csv"), "k int, v double").fillna(-1).collect()) == [(1, -1), (2, -1), (3, 4.5)]
    for s in ("a", "b"):
        IO.append_ledger(spark, str(tmp_path / "l"), s, {"n": "1"})
    assert IO.read_ledger(spark, str(tmp_path / "l")).count() == 2


def test_loo_errors_against_refits():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(2, 30))
    t = x * y + rng.normal(size=30)
    terms = np.stack([x**i * y**j for i in range(3) for j in range(3 - i)], 1)
    want = []
    for i in range(30):
        keep = np.arange(30) != i
        want.append(t[i] - terms[i] @ np.linalg.lstsq(terms[keep], t[keep], rcond=None)[0])
    assert np.allclose(K.loo_errors(x, y, t, 2), want)


def _ring(*p):
    return [list(map(float, q)) for q in p]


def test_polygon_areas():
    square, hole = _ring((0, 0), (10, 0), (10, 10), (0, 10)), _ring((3, 3), (7, 3), (7, 7), (3, 7))
    e = G.sides([square, hole])
    assert G.area(e) == pytest.approx(84)
    diamond = G.sides([_ring((0, 5), (5, 0), (10, 5), (5, 10))])
    assert G.common_area(G.sides([square]), diamond) == pytest.approx(50)
    # The hole's corners lie at distance 4 from the centre along the axes' sum: none is cut off.
    assert G.common_area(e, diamond) == pytest.approx(34)
    assert G.common_area(e, G.sides([_ring((20, 0), (30, 0), (30, 10))])) == 0 and G.area(G.sides([[], _ring((1, 1), (2, 2))])) == 0
    bow = G.sides([_ring((0, 0), (10, 10), (10, 0), (0, 10))])
    assert G.area(bow) == pytest.approx(50)


def test_polygon_insets():
    e = G.sides([_ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))])
    assert [G.inset_area(e, r) for r in (0, 1, 4, 5, 9)] == pytest.approx([100, 64, 4, 0, 0])
    ell = G.sides([_ring((0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10))])
    # Round about the inner corner: two bars of 2 x 9 that share 2 x 2 less a quarter of what an arc leaves.
    assert G.inset_area(ell, 1) == pytest.approx(2 * 8 + 2 * 8 - 4 + (1 - math.pi / 4), abs=2e-3)
    rng = np.random.default_rng(3)
    star = [[math.cos(a) * q + 20, math.sin(a) * q + 20] for a, q in zip(np.linspace(0, 6.2, 15), rng.uniform(5, 15, 15))]
    s = G.sides([star])
    x, y = np.meshgrid(np.arange(0, 40, 0.1) + 0.05, np.arange(0, 40, 0.1) + 0.05)
    p = np.stack([x.ravel(), y.ravel()], 1)
    inside = ((s[:, 1] > p[:, 1:]) != (s[:, 3] > p[:, 1:])) & (p[:, :1] < s[:, 0] + (s[:, 2] - s[:, 0]) * (p[:, 1:] - s[:, 1]) / np.where(s[:, 3] != s[:, 1], s[:, 3] - s[:, 1], 1))
    d = s[:, 2:] - s[:, :2]
    t = np.clip(((p[:, None] - s[:, :2]) * d).sum(2) / (d**2).sum(1), 0, 1)
    far = np.linalg.norm(s[:, :2] + t[:, :, None] * d - p[:, None], axis=2).min(1)
    assert G.inset_area(s, 1.5) == pytest.approx(0.01 * (inside.sum(1) % 2 == 1)[far >= 1.5].sum(), rel=0.02)
    got = {(r, c) for r, cols in G.pixels(s, 0.1, 1.5) for c in cols}
    want = {(round(q[1] * 10 - 0.5), round(q[0] * 10 - 0.5)) for q in p[(inside.sum(1) % 2 == 1) & (far >= 1.5)]}
    assert got == want


def test_thin_plate_leave_one_out():
    rng = np.random.default_rng(1)
    p, t = rng.uniform(size=(12, 2)), rng.normal(size=12)

    def plate(a, v, at):
        f = lambda q, w: (lambda d2: np.where(d2 > 0, d2 * np.log(np.where(d2 > 0, d2, 1)) / 2, 0))(((q[:, None] - w[None]) ** 2).sum(2))
        one = lambda q: np.hstack([np.ones((len(q), 1)), q])
        c = np.linalg.solve(np.block([[f(a, a), one(a)], [one(a).T, np.zeros((3, 3))]]), np.r_[v, 0, 0, 0])
        return (f(at, a) @ c[: len(a)] + one(at) @ c[len(a) :])[0]

    want = [t[i] - plate(np.delete(p, i, 0), np.delete(t, i), p[i : i + 1]) for i in range(12)]
    assert W.loo_plate(p, t) == pytest.approx(want, rel=1e-6)
    rows, cols = np.array([0.0, 10, 30]), np.array([0.0, 5])
    plane = 2 * rows[:, None] + 3 * cols[None]
    assert W.lattice_value(rows, cols, plane, np.array([4.0, 25, 99]), np.array([1.0, 4, -7])) == pytest.approx([11, 62, 60])


def test_surfaces_follow_a_parabola(spark):
    pts = [("s", float(i), float(j), 3 + i * j / 50 + j * j / 9, 7.0 - i) for i in range(0, 60, 10) for j in range(0, 30, 6)]
    at = spark.createDataFrame([("s", 33.0, 17.0, 1.0), ("t", 0.0, 0.0, 1.0)], "scene string, row double, col double, value double")
    out = W.located(at, spark.createDataFrame(pts, "scene string, row double, col double, x double, y double")).collect()
    assert len(out) == 1 and (out[0]["x"], out[0]["y"]) == pytest.approx((3 + 33 * 17 / 50 + 17 * 17 / 9, -26))


def test_binary_files(spark, tmp_path):
    a = np.arange(70 * 5, dtype="<f8").reshape(70, 5)
    a[3, 2] = np.nan
    (tmp_path / "x.tif").write_bytes(IO2.tiff_bytes(a, rows=16, nodata="-1"))
    rows, cols = np.indices(a.shape)
    got = {(r["row"], r["col"]): r["value"] for r in IO2.read_rasters(IO2.landed(spark, str(tmp_path), "*.tif")).collect()}
    assert got.pop((3, 2)) is None and len(got) == 349 and got[(69, 4)] == 349
    shapes = [[_ring((0, 0), (0, 2), (2, 0), (0, 0)), _ring((5, 5), (5, 6), (6, 5), (5, 5))], []]
    (tmp_path / "p.shp").write_bytes(IO2.shapefile_bytes(shapes))
    out = sorted((r["record"], r["rings"], r["attributes"]) for r in IO2.read_shapefiles(IO2.landed(spark, str(tmp_path), "*.shp")).collect())
    assert out == [(0, shapes[0], None), (1, [], None)]
    (tmp_path / "t.xlsx").write_bytes(IO2.sheet_bytes([["a", "b"], ["<x> & y", 3]]))
    cells = [r["cells"] for r in IO2.read_sheets(IO2.landed(spark, str(tmp_path), "*.xlsx")).orderBy("row").collect()]
    assert cells == [{"A": "a", "B": "b"}, {"A": "<x> & y", "B": "3"}]


def test_polygon_joins_edge_rows(spark):
    kind = "id long, rings array<array<array<double>>>"
    left = spark.createDataFrame([(1, [_ring((0, 0), (4, 0), (4, 4), (0, 4))]), (2, None), (3, []), (4, [_ring((50, 50), (51, 50), (51, 51))])], kind)
    right = spark.createDataFrame([(9, [_ring((2, 0), (9, 0), (9, 9), (2, 9))]), (8, [_ring((0, 0), (2, 0), (2, 4), (0, 4))]), (7, [_ring((4, 0), (9, 0), (9, 9))])], kind)
    assert sorted(map(tuple, PC.largest_overlap(left, right, 3.0).collect()), key=str) == [(1, 8, 0.5), (2, None, None), (3, None, None), (4, None, None)]
    assert {r["id"]: r["pure"] for r in PC.pure_fraction(left, [2.0]).collect()} == {1: pytest.approx(0.25), 2: None, 3: None, 4: 0.0}
    labels, levels = PC.rasterise_ladder(left, 5.0)
    assert sorted(map(tuple, levels.collect())) == [(1, 2), (4, 2)] and labels.count() == 2
