"""Robust scores, ranks, bins and rank statistics, by window functions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of values that a rank over all rows is counted in.
RANGES = 256


def _within(keys: list[str]) -> Window:
    return Window.partitionBy(*keys)


def robust_z(df: DataFrame, value: str, out: str, keys: list[str] | None = None, bound: float = 4.0, least: int = 10, missing: float | None = 0.0) -> DataFrame:
    """(value - median) / (1.4826 MAD), bounded. Fewer than least values, or MAD 0: 0. Missing values get missing.

    Medians are two aggregations joined back, so a group is never sorted in one window.
    """
    keys = keys or []
    g = [F.col(k).alias(f"_{k}") for k in keys]

    def back(left: DataFrame, agg: DataFrame) -> DataFrame:
        if not keys:
            return left.crossJoin(F.broadcast(agg))
        cond = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return left.join(agg, cond, "left").drop(*[f"_{k}" for k in keys])

    centre = df.groupBy(*g).agg(F.median(value).alias("_c"), F.count(value).alias("_n"))
    d = back(df, centre)
    spread = d.groupBy(*g).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("_c")))).alias("_s"))
    d = back(d, spread)
    z = F.least(F.greatest((F.col(value) - F.col("_c")) / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(-bound)), F.lit(bound))
    z = F.when(F.col(value).isNull(), F.lit(missing)).when((F.col("_n") < least) | (F.col("_s") <= 0), F.lit(0.0)).otherwise(z)
    return d.withColumn(out, z).drop("_c", "_n", "_s")


def avg_rank(value: str, keys: list[str] | None = None) -> Column:
    """Average rank among the non-null values of the group; null for null. Without keys all rows meet in one task: ranked() has no such bound."""
    keys = keys or []
    w = _within(keys)
    ties = Window.partitionBy(*keys, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(w.orderBy(F.col(value).asc_nulls_last())) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def rank_pct(value: str, keys: list[str]) -> Column:
    return avg_rank(value, keys) / F.count(value).over(_within(keys))


def ranked(df: DataFrame, names: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """df with the average ranks of columns (names: rank to column) among all rows, or those of the group; null for null.

    Without keys the values are counted first, so that equal ones are one row; the counts are dealt into RANGES ranges
    at approximate quantiles and summed within each, and a range begins at the sum of the lower ones. No task sorts all.
    """
    if keys:
        return df.withColumns({out: avg_rank(value, keys) for out, value in names.items()})
    probes = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    for out, value in names.items():
        v = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"))
        edges = F.broadcast(v.agg(F.array_distinct(F.percentile_approx("_v", probes)).alias("_e")))
        counts = v.groupBy("_v").agg(F.count(F.lit(1)).alias("_c")).crossJoin(edges).select("_v", "_c", F.size(F.filter("_e", lambda e: e < F.col("_v"))).alias("_p"))
        lower = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows
        starts = counts.groupBy("_p").agg(F.sum("_c").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_s"))
        upto = Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rank = F.col("_s") + F.sum("_c").over(upto) - (F.col("_c") - 1) / 2
        ranks = counts.join(F.broadcast(starts), "_p").select("_v", rank.alias(out))
        df = df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")
    return df


def spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None, least: int = 0) -> DataFrame:
    """Pearson correlation of average ranks over rows where both are there: keys, n, rho (null under least rows)."""
    keys = keys or []
    d = ranked(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), {"_rx": x, "_ry": y}, keys)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, F.corr("_rx", "_ry")).alias("rho"))


def partial_spearman(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    d = ranked(d, {f"_r{c}": c for c in (x, y, z)})
    a = d.agg(F.corr(f"_r{x}", f"_r{y}").alias("xy"), F.corr(f"_r{x}", f"_r{z}").alias("xz"), F.corr(f"_r{y}", f"_r{z}").alias("yz"))
    return a.select(((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))).alias("rho"))


def ols_residual(df: DataFrame, y: str, x: str, out: str, least: int = 30) -> DataFrame:
    fit = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.count(F.lit(1)).alias("_n"))
    return df.crossJoin(F.broadcast(fit)).withColumn(out, F.when(F.col("_n") > least, F.col(y) - (F.col("_a") + F.col("_b") * F.col(x)))).drop("_a", "_b", "_n")


def kruskal(df: DataFrame, value: str, group: str, least: int = 6) -> DataFrame:
    """H with tie correction over groups of at least so many values; k, n, h, epsilon2."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    d = d.withColumn("_gn", F.count(F.lit(1)).over(Window.partitionBy(group))).where(F.col("_gn") >= least)
    d = ranked(d, {"_r": value})
    ties = d.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    g = d.groupBy(group).agg(F.sum("_r").alias("rs"), F.count(F.lit(1)).alias("ng"))
    s = g.agg(F.count(F.lit(1)).alias("k"), F.sum("ng").alias("n"), F.sum(F.col("rs") ** 2 / F.col("ng")).alias("q")).crossJoin(ties)
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n**3 - n))
    return s.withColumn("h", h).select("k", "n", "h", ((F.col("h") - F.col("k") + 1) / (F.col("n") - F.col("k"))).alias("epsilon2"))


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """U of the rows where first is true against the others, and the normal approximation's z (without tie correction)."""
    d = df.where(F.col(value).isNotNull()).withColumn("_f", first)
    d = ranked(d, {"_r": value})
    a = d.agg(F.sum(F.when(F.col("_f"), F.col("_r"))).alias("rs"), F.count_if(F.col("_f")).alias("n1"), F.count_if(~F.col("_f")).alias("n2"))
    a = a.withColumn("u", F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2)
    sd = F.sqrt(F.col("n1").cast("double") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12)
    return a.select("n1", "n2", "u", ((F.col("u") - F.col("n1") * F.col("n2") / 2) / sd).alias("z"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa: po, pe, kappa (null where pe is 1)."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = d.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    n = cells.agg(F.sum("c").alias("n"), (F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)) / F.sum("c")).alias("po"))
    mx = cells.groupBy(F.col("x").alias("k")).agg(F.sum("c").alias("cx"))
    my = cells.groupBy(F.col("y").alias("k")).agg(F.sum("c").alias("cy"))
    pe = mx.join(my, "k").agg(F.coalesce(F.sum(F.col("cx").cast("double") * F.col("cy")), F.lit(0.0)).alias("s"))
    out = n.crossJoin(pe).withColumn("pe", F.col("s") / (F.col("n").cast("double") * F.col("n")))
    return out.select("po", "pe", F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")).alias("kappa"))


def quantile_edges(df: DataFrame, value: str, q: int) -> DataFrame:
    """One row: the distinct quantile edges of value, as an array."""
    probs = ", ".join(f"{i}d/{q}" for i in range(q + 1))
    return df.agg(F.array_distinct(F.expr(f"percentile({value}, array({probs}))")).alias("edges"))


def qcut(df: DataFrame, value: str, q: int, out: str) -> DataFrame:
    """Quantile bins from 0, right-closed, the least value in the first; equal edges count once."""
    d = df.crossJoin(F.broadcast(quantile_edges(df, value, q)))
    bin_ = F.greatest(F.size(F.filter("edges", lambda e: e < F.col(value))) - 1, F.lit(0))
    return d.withColumn(out, F.when(F.col(value).isNotNull(), bin_)).drop("edges")


def morans_i(edges: DataFrame, values: DataFrame) -> DataFrame:
    """edges: src, dst, and v (the value at dst) where it is at hand; values: id, v. n / W * sum z_i z_j / sum z^2.

    With v no edge moves: those of a src are summed where they stand.
    """
    mean = F.broadcast(values.agg(F.avg("v").alias("_m")))
    z = values.crossJoin(mean).select("id", (F.col("v") - F.col("_m")).alias("z"))
    near = edges if "v" in edges.columns else edges.join(values.select(F.col("id").alias("dst"), "v"), "dst")
    near = near.crossJoin(mean).groupBy("src").agg(F.sum(F.col("v") - F.col("_m")).alias("zj"), F.count(F.lit(1)).alias("c"))
    num = near.join(z.select(F.col("id").alias("src"), F.col("z").alias("zi")), "src").agg(F.sum(F.col("zi") * F.col("zj")).alias("num"), F.coalesce(F.sum("c"), F.lit(0)).alias("w"))
    den = z.agg(F.sum(F.col("z") ** 2).alias("den"), F.count(F.lit(1)).alias("n"))
    return num.crossJoin(den).select((F.col("n") / F.col("w") * F.col("num") / F.col("den")).alias("morans_i"), "n", "w")


def md5_order(seed: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy(md5_order(seed, F.col(key)), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def perm_pvalue(df: DataFrame, reps: int, width: int = 4096) -> DataFrame:
    """df: id (whole numbers), x, y. p: (1 + permutations of y whose correlation with x is as large in size) / (reps + 1).

    Rows are numbered by id; permutation rep gives row i the y of the i-th id in the order of md5(rep|id). Numbers are
    counted within ranges of ids and within prefixes of the hash, and begin at the sum of the lower ones' counts.
    """
    def numbered(rows: DataFrame, keys: list[str], part: str, order: list[str]) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        i = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))
        return rows.withColumn("_r", i).join(starts.hint("merge"), [*keys, part]).withColumn("i", F.col("_r") + F.col("_s")).drop("_r", "_s", part)

    t = numbered(df.select("id", "x", F.lit(0).alias("_all"), F.floor(F.col("id") / width).alias("_part")), ["_all"], "_part", ["id"]).select("i", "x")
    s = df.select("id", "y", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")).withColumn("h", F.md5(F.concat_ws("|", "rep", "id")))
    s = numbered(s.withColumn("_part", F.substring("h", 1, 2)), ["rep"], "_part", ["h", "id"]).select("rep", "i", "y")
    null = s.join(t.hint("merge"), "i").groupBy("rep").agg(F.abs(F.corr("x", "y")).alias("c"))
    seen = df.agg(F.abs(F.corr("x", "y")).alias("o"))
    return null.crossJoin(F.broadcast(seen)).agg(((1 + F.count_if(F.col("c") >= F.col("o"))) / F.lit(reps + 1.0)).alias("p"), F.count(F.lit(1)).alias("reps"))
