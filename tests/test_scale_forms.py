"""Ranks, as-of values and neighbours in the forms that hold at any size, against plain versions."""

import random

import pytest

from terrazo.operators import analytics, relational, spatial


def test_ranks_over_all_rows(spark):
    rng = random.Random(1)
    values = [rng.choice([None, 1.5, 1.5, 2.0, rng.uniform(-5, 5), 0.0, -0.0]) for _ in range(3000)] + [7.0] * 1500
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(5)
    out = analytics.ranked(d, {"r": "v"})
    there = sorted(v for v in values if v is not None)
    first, last = {}, {}
    for i, v in enumerate(there, 1):
        first.setdefault(v, i)
        last[v] = i
    assert {r["id"]: r["r"] for r in out.collect()} == {i: None if v is None else (first[v] + last[v]) / 2 for i, v in enumerate(values)}
    assert analytics.ranked(d.limit(0), {"r": "v"}).collect() == []


def test_a_rank_sorts_no_rows_in_one_partition(spark):
    d = spark.range(1000).selectExpr("id", "id % 37 v")
    plan = analytics.ranked(d, {"r": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and all("_p" in line for line in plan.splitlines() if "windowspecdefinition" in line)


def test_asof_across_empty_ranges(spark):
    rng = random.Random(2)
    keys = sorted({rng.choice([rng.uniform(0, 50), rng.uniform(9e5, 9.1e5), rng.uniform(4e6, 4e6 + 10)]) for _ in range(300)})
    asked = [rng.uniform(-100, 5e6) for _ in range(200)] + keys[:20] + [1e7, None]
    left = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "id long, x double")
    right = spark.createDataFrame([(k, f"v{k}") for k in keys], "k double, v string")
    got = {r["id"]: r["v"] for r in relational.asof_forward(left, right, "x", "k", "v", 7.0).collect()}
    assert got == {i: f"v{next((k for k in keys if x is not None and k >= x), keys[-1])}" for i, x in enumerate(asked)}


@pytest.mark.parametrize("same", [None, "g"])
def test_neighbours_of_points_far_away(spark, same):
    rng = random.Random(3)
    points = [(i, rng.uniform(0, 30), rng.uniform(0, 30), i % 2) for i in range(150)] + [(900, 4e6, -3e6, 0), (901, 4e6 + 1, -3e6, 1), (902, -9e5, 12.0, 1)]
    d = spark.createDataFrame(points, "id long, x double, y double, g int")
    got = {}
    for r in spatial.knn(d, 4, 1.0, same).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    for i, x, y, g in points:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b, h in points if j != i and (same is None or h == g))[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in near]


@pytest.mark.parametrize("same", [None, "g"])
def test_neighbours_in_blocks_of_any_density(spark, same, monkeypatch):
    from terrazo.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = random.Random(6)
    points = [(rng.gauss(0, 1e-3), rng.gauss(0, 1e-3)) for _ in range(500)] + [(rng.uniform(-50, 50), float(rng.randrange(3))) for _ in range(300)] + [(1.0, 2.0)] * 150 + [(float(i % 12), float(i // 12)) for i in range(144)] + [(1e7, 1e7)]
    rng.shuffle(points)
    points = [(i * 3, *p, i % 2) for i, p in enumerate(points)]
    d = spark.createDataFrame(points, "id long, x double, y double, g int")
    got = {}
    for r in spatial.knn(d, 5, 1.0, same).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"], r["d2"]))
    for i, x, y, g in points:
        near = sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b, h in points if j != i and (same is None or h == g))[:5]
        assert sorted(got[i]) == [(n, j, d2) for n, (d2, j) in enumerate(near, 1)]


def test_neighbours_make_no_pairs_in_spark(spark, sf):
    from terrazo.plans.catalog import QUERIES

    plan = QUERIES["join_knn"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "explode" not in plan.lower()


def test_morans_i_joins_edges_only(spark, sf):
    from terrazo.plans.catalog import QUERIES

    plan = QUERIES["morans_i"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "gx" not in plan  # no pairs of points by cells


def test_morans_i_moves_no_edges(spark, sf):
    from terrazo.plans.catalog import QUERIES

    plan = QUERIES["morans_i"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "dst" not in "".join(x for x in plan.splitlines() if "Join" in x or "Window" in x or "Exchange" in x)
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") + plan.count("BroadcastHashJoin") <= 1


@pytest.mark.parametrize("same", [None, "g"])
def test_morans_i_of_points_with_copies(spark, same, monkeypatch):
    from terrazo.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = random.Random(11)
    places = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(300)]
    places += [(1.0, 2.0)] * 40 + [(0.0, -0.0), (0.0, 0.0)] + [rng.choice(places) for _ in range(100)]
    rng.shuffle(places)
    points = [(i * 3, *p, i % 2, None if i % 17 == 0 else rng.uniform(-3, 9)) for i, p in enumerate(places)]
    d = spark.createDataFrame(points, "id long, x double, y double, g int, v double")
    value, near = {p[0]: p[4] for p in points}, {}
    for i, x, y, g, _ in points:
        near[i] = [j for _, j in sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b, h, _ in points if j != i and (same is None or h == g))[:5]]
    got = {}
    for r in spatial.knn(d, 5, 1.0, same, "v").collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"], r["v"]))
    assert {i: sorted(l) for i, l in got.items()} == {i: [(n, j, value[j]) for n, j in enumerate(l, 1)] for i, l in near.items()}
    there = [v for v in value.values() if v is not None]
    z = {i: None if v is None else v - sum(there) / len(there) for i, v in value.items()}
    num = sum(z[i] * z[j] for i, l in near.items() for j in l if z[i] is not None and z[j] is not None)
    want = len(points) / (5 * len(points)) * num / sum(v * v for v in z.values() if v is not None)
    for edges in (spatial.knn(d, 5, 1.0, same, "v"), spatial.knn(d, 5, 1.0, same).select("src", "dst")):
        out = analytics.morans_i(edges, d.select("id", "v")).first()
        assert abs(out["morans_i"] - want) < 1e-9 and (out["n"], out["w"]) == (len(points), 5 * len(points))


def test_boxes_overlap_without_a_kernel(spark, monkeypatch):
    from terrazo.functions import polygons
    from terrazo.operators import parcels

    rng = random.Random(8)

    def ring(n, turned):
        x, y, w, h = rng.randrange(40), rng.randrange(30), rng.randrange(0 if turned else 1, 9), rng.randrange(1, 9)
        q = [[float(a), float(b)] for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
        k = n % 4
        q = (q[k:] + q[:k])[:: 1 if n % 3 else -1]
        if n % 7 == 0:
            q = [[float(x), float(y)], [x + 5.0, y + 2.0], [x + 1.0, y + 6.0]]  # no rectangle
        return [q + [q[0]] if n % 2 else q]

    left, right = [(i, ring(i, True)) for i in range(80)], [(900 - i, ring(i, False)) for i in range(70)]
    right += [(5000 - i, q) for i, (_, q) in enumerate(right)]  # copies, with other ids
    want = {}
    for i, q in left:
        e = polygons.sides(q)
        shared = [(-polygons.common_area(e, polygons.sides(z)), j) for j, z in right]
        a, j = min((round(a, 9), j) for a, j in shared)
        want[i] = (j, -a / polygons.area(e)) if a < 0 else (None, None)
    kind = "id long, rings array<array<array<double>>>"
    l, r = spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)
    got = {x["id"]: (x["match_id"], x["overlap_frac"]) for x in parcels.largest_overlap(l, r, 4.0).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and (got[i][1] is None or abs(got[i][1] - want[i][1]) < 1e-9) for i in want)
    asked = []
    monkeypatch.setattr(parcels, "overlaps", lambda a, b, cell, f=parcels.overlaps: asked.extend([a, b]) or f(a, b, cell))
    box = [(1, [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]])]
    assert parcels.largest_overlap(spark.createDataFrame(box, kind), spark.createDataFrame(box, kind), 4.0).first()["overlap_frac"] == 1.0
    assert all(a.count() == 0 or b.count() == 0 for a, b in zip(asked[::2], asked[1::2], strict=True))
