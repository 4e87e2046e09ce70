"""Queries that read whole tables, against plain Python over the same rows."""

import hashlib
from collections import defaultdict

import numpy as np

from terrazo.plans.catalog import QUERIES


def rows(spark, sf, name, *columns):
    return [tuple(x) for x in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def test_split_half_takes_every_group_and_25_splits(spark, sf):
    groups = defaultdict(list)
    for g, *x in rows(spark, sf, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice"):
        groups[g].append(x)
    assert max(groups) > 50
    want = {}
    for g, held in groups.items():
        d = []
        for rep in range(25):
            v = [x[2] for x in sorted(held, key=lambda x: (md5(rep, x[0], x[1]), *x))]
            if len(v) > 1:
                d.append(np.mean(v[1::2]) - np.mean(v[::2]))
        want[g] = float(np.std(d)) if d else None
    got = {x["g"]: x["sd"] for x in QUERIES["split_half"](spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all((got[g] is None) == (want[g] is None) and (got[g] is None or abs(got[g] - want[g]) < 0.001) for g in want)


def test_split_half_deals_each_row_once(spark, sf, monkeypatch):
    plan = QUERIES["split_half"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan.lower() and plan.count("Exchange") == 1
    from terrazo.operators import halves

    rng = np.random.default_rng(4)
    pick = lambda most, n: [None if x == most else int(x) for x in rng.integers(0, most + 1, n)]
    held = [(None if g == 9 else g * 10**12 - 5, a, b, None if v == 50 else v / 4) for g, a, b, v in zip(rng.integers(0, 10, 900), pick(30, 900), pick(4, 900), rng.integers(0, 51, 900).tolist(), strict=True)]
    held = [(None if g is None else int(g), *x) for g, *x in held] + [(77, 1, 1, 2.0), (78, 1, 1, None), (78, 1, 2, None)]
    last = lambda x: (x is None, x or 0)
    want = {}
    for g in {x[0] for x in held}:
        d = []
        for rep in range(12):
            rows_ = [x for x in held if x[0] == g]
            v = [x[3] for x in sorted(rows_, key=lambda x: (x[1] is None or x[2] is None, "" if None in x[1:3] else md5(rep, x[1], x[2]), *map(last, x[1:])))]
            two = [[x for x in v[i::2] if x is not None] for i in (0, 1)]
            if all(two):
                d.append(np.mean(two[1]) - np.mean(two[0]))
        want[g] = float(np.std(d)) if d else None
    df = spark.createDataFrame(held, "g long, a long, b int, v double")
    for heavy in (halves.HEAVY, 1):  # by the kernel, and by windows
        monkeypatch.setattr(halves, "HEAVY", heavy)
        got = {x["g"]: x["sd"] for x in halves.half_sd(df, 12).collect()}
        assert got.keys() == want.keys()
        assert all((got[g] is None) == (want[g] is None) and (got[g] is None or abs(got[g] - want[g]) < 1e-9) for g in want)


def grown(seed, cells):
    """Cells joined to seed by sides."""
    seen, todo = {seed}, [seed]
    while todo:
        y, x = todo.pop()
        for n in ((y, x + 1), (y + 1, x), (y, x - 1), (y - 1, x)):
            if n in cells and n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def means(grid, radius):
    """Mean of the present cells around each present cell; grid: (y, x) to value."""
    span = range(-radius, radius + 1)
    return {(y, x): np.mean([grid[y + j, x + i] for j in span for i in span if (y + j, x + i) in grid]) for y, x in grid}


def test_landcover_masks_need_every_date_and_large_blobs(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(400, 500, (2, 80, 100)).astype(float)
    for g in (a, b):
        g[5:14, 5:14] = 1  # large and dark on both dates
        g[30:36, 60:66] = 1  # small
        g[40:46, 10:16] = 999
    a[20:28, 30:38] = 1  # on one date only
    there = rng.random(a.shape) > 0.1
    cells = [(y, x, float(a[y, x]), float(b[y, x]) if (y, x) != (8, 8) else None) for y in range(80) for x in range(100) if there[y, x]]
    layers = [{(y, x): v[k] for y, x, *v in cells if v[k] is not None} for k in (0, 1)]
    have = layers[0].keys() & layers[1].keys()
    m = [means(g, 2) for g in layers]
    lo, hi = ([np.percentile([g[c] for c in have], q) for g in m] for q in (2, 99))
    dark = {c for c in have if all(g[c] <= t + 1e-9 for g, t in zip(m, lo, strict=True))}
    built = {c for c in have if all(g[c] >= t - 1e-9 for g, t in zip(m, hi, strict=True))}
    water = {c for c in dark if len(grown(c, dark)) >= 40}
    assert water and water < dark and built
    from terrazo.operators.spatial import landcover_masks

    got = landcover_masks(spark.createDataFrame(cells, "rr long, cc int, a double, b double"), ["a", "b"]).collect()
    assert {(r["rr"], r["cc"]) for r in got} == have
    for name, want in (("dark", dark), ("water", water), ("built", built), ("crop", have - water - built)):
        assert {(r["rr"], r["cc"]) for r in got if r[name]} == want, name


def test_means_over_tiles_and_exact_percentiles(spark, monkeypatch):
    from terrazo.operators import spatial

    rng = np.random.default_rng(7)
    cells = {(int(y), int(x)): float(v) for y, x, v in zip(rng.integers(-40, 40, 900), rng.integers(-30, 60, 900), rng.normal(size=900), strict=True)} | {(10**9, -(10**9)): 3.0, (10**9 + 1, 5): 4.0}
    df = spark.createDataFrame([(*c, v) for c, v in cells.items()], "rr long, cc int, v double")
    plan = spatial.smooth(df, ["v"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan
    want = means(cells, 2)
    for tile, dense in ((16, 64), (64, -10_000)):  # small tiles, and no dense arrays
        monkeypatch.setattr(spatial, "TILE", tile)
        monkeypatch.setattr(spatial, "DENSE", dense)
        got = {(r["rr"], r["cc"]): r["v"] for r in spatial.smooth(df, ["v"], 2).collect()}
        assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)
    for v in (rng.normal(size=5000).tolist(), [1.0] * 700 + [2.0] * 10, [5.0]):
        d = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
        assert np.allclose(spatial.percentiles(d, "v", [0.02, 0.5, 0.99]), np.percentile(v, [2, 50, 99]), rtol=0, atol=1e-12)


def test_blobs_join_long_winding_runs(spark):
    cells = {(y, x) for y in range(21) for x in range(21) if y % 2 == 0 or x == (20 if y % 4 == 1 else 0)} | {(40, 0), (41, 1)}
    from terrazo.operators.spatial import blobs

    got = blobs(spark.createDataFrame(sorted(cells), "rr long, cc int")).collect()
    assert {(r["rr"], r["cc"]): r["size"] for r in got} == {c: len(grown(c, cells)) for c in cells}
    assert len({r["blob"] for r in got}) == 3


def test_landcover_candidates_leave_out_nodata(spark, sf):
    held = defaultdict(list)
    for y, x, v in rows(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice"):
        held[y, x].append(v)
    got = QUERIES["landcover_candidates"](spark, sf).collect()
    assert {(r["rr"], r["cc"]) for r in got} == held.keys()
    span = range(-4, 5)
    for r in got[::40]:
        near = [v for j in span for i in span for v in held.get((r["rr"] + j, r["cc"] + i), [])]
        assert abs(r["mean"] - np.mean(near)) < 1e-4
    m = [r["mean"] for r in got]
    assert sum(r["dark"] for r in got) == sum(v <= np.percentile(m, 1) for v in m)
    assert sum(r["bright"] for r in got) == sum(v >= np.percentile(m, 99.7) for v in m)
    from terrazo.operators.spatial import landcover_candidates

    few = spark.createDataFrame([(0, 0, 0.0), (0, 1, 4.0), (0, 2, 8.0)], "rr long, cc int, v double")
    assert {(r["cc"], r["mean"]) for r in landcover_candidates(few, "v").collect()} == {(1, 6.0), (2, 6.0)}


def test_asof_lookup_uses_every_part(spark, sf):
    curve = {}
    for k, v in rows(spark, sf, "part", "p_retailprice", "p_size"):
        curve[k] = min(v, curve.get(k, v))
    want = {s: curve[min((k for k in curve if k >= m), default=max(curve))] for s, m in rows(spark, sf, "supplier", "s_suppkey", "s_acctbal")}
    assert {r["s_suppkey"]: r["v"] for r in QUERIES["asof_lookup"](spark, sf).collect()} == want


def test_perm_pvalue_takes_every_customer_and_199_permutations(spark, sf):
    t = sorted(rows(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey"))
    from terrazo.operators.analytics import perm_pvalue

    def p(held, reps):
        x, y = np.array([r[1] for r in held], float), np.array([r[2] for r in held], float)
        order = lambda rep: sorted(range(len(held)), key=lambda i: (md5(rep, held[i][0]), held[i][0]))
        null = [abs(np.corrcoef(x, y[order(rep)])[0, 1]) for rep in range(1, reps + 1)]
        return (1 + sum(c >= abs(np.corrcoef(x, y)[0, 1]) for c in null)) / (reps + 1)

    got = QUERIES["perm_pvalue"](spark, sf).first()
    assert got["reps"] == 199 and abs(got["p"] - p(t, 199)) < 1e-6
    tied = [(k * 3, float(k), k + k % 5) for k in range(200)]  # ids over several ranges, a strong link: the least p
    few = perm_pvalue(spark.createDataFrame(tied, "id long, x double, y long"), 199, 50).first()
    assert few["p"] == p(tied, 199) == 1 / 200


def plain_turns(x, start, near, area, prior, beta=0.6, seed=0):
    """The reference's turns, written out: gradient descent, label by label, cost by cost."""
    from terrazo.operators.composite import solve_prior

    w = np.array([[np.exp(-sum((x[i] - x[j]) ** 2) / (2 * x.shape[1])) for j in near[i]] for i in range(len(x))])
    labels, rng = start.argmax(1), np.random.default_rng(seed)
    for _ in range(8):
        seen = sorted(set(labels.tolist()))
        if len(seen) < 2:
            break
        hot = np.array([[float(c == s) for s in seen] for c in labels])
        cw = hot @ (len(x) / (len(seen) * hot.sum(0)))
        z, coef = np.column_stack([x, np.ones(len(x))]), np.zeros((x.shape[1] + 1, len(seen)))
        keep = np.append(np.ones(x.shape[1]), 0.0)[:, None]
        for _ in range(20000):
            e = np.exp(z @ coef)
            e /= e.sum(1, keepdims=True)
            coef -= 2.0 / (cw.sum() * (z**2).sum(1).max()) * (z.T @ (cw[:, None] * (e - hot)) + keep * coef)
        p = np.zeros(start.shape)
        p[:, seen] = e
        log_p = np.log(np.maximum(p, 1e-9))
        q = np.exp(log_p + solve_prior(log_p, prior, area))
        u = np.log(np.maximum(q / q.sum(1, keepdims=True), 1e-12))
        new, last = labels.copy(), None
        for _ in range(30):
            for i in rng.permutation(len(x)):
                new[i] = np.argmin([-u[i, c] + beta * sum(w[i][new[near[i]] != c]) for c in range(start.shape[1])])
            now = sum(-u[i, new[i]] + beta * sum(w[i][new[near[i]] != new[i]]) for i in range(len(x)))
            if last is not None and abs(last - now) < 1e-6:
                break
            last = now
        changed = np.mean(new != labels)
        labels = new
        if changed < 0.005:
            break
    return labels


def test_mrf_labels_alternate_regression_prior_and_sweeps(spark):
    from terrazo.operators.composite import mrf_labels

    rng = np.random.default_rng(5)
    n = 120
    f, xy, area = rng.normal(size=(n, 3)), rng.normal(size=(n, 2)), rng.uniform(0.5, 2, n)
    p = np.exp(f) / np.exp(f).sum(1, keepdims=True)
    mid = np.median(f, 0)
    x = (f - mid) / (1.4826 * np.median(np.abs(f - mid), 0))
    near = np.array([sorted((j for j in range(n) if j != i), key=lambda j: (((xy[i] - xy[j]) ** 2).sum(), j))[:8] for i in range(n)])
    df = spark.createDataFrame([(1, i, *map(float, xy[i]), f[i].tolist(), p[i].tolist(), float(area[i])) for i in range(n)], "g int, id int, x double, y double, f array<double>, p array<double>, area double")
    for prior in ([0.5, 0.3, 0.2], [0.1, 0.2, 0.7]):
        got = np.array([r["label"] for r in mrf_labels(df, "g", "id", prior).orderBy("id").collect()])
        assert (got == plain_turns(x, p, near, area, np.array(prior))).mean() >= 0.98
        assert np.abs(np.bincount(got, area, 3) / area.sum() - prior).max() < 0.25


def test_energy_never_rises_in_sweeps():
    from terrazo.operators.composite import energy, settle

    rng = np.random.default_rng(2)
    u = np.log(rng.dirichlet([1, 1, 1], 80))
    # Both directions of each link, so that a label's own cost is the energy's change.
    near = np.column_stack([(np.arange(80) + 1) % 80, (np.arange(80) - 1) % 80])
    w, labels = np.ones((80, 2)), u.argmax(1)
    after = settle(u, near, w, 0.6, labels, np.random.default_rng(0))
    assert energy(u, near, w, 0.6, after) <= energy(u, near, w, 0.6, labels)
