"""URL filter: rules first, then gradient-boosted trees over lexical features, with DataFrame functions only.

The trees are grown from labelled URLs: a table of (url, label) if one is given; else all URLs of the pages, labelled
block where a part of the host is one of SEEDS and allow elsewhere. The trees see neither the seeds nor the rules, only
lexical features, so they carry the seeds' likeness over to other hosts, whatever these are called. Features are whole
numbers in bins that are fixed below, so the labelled URLs shrink to a table of bin counts before the first tree. A tree
has two levels and takes one aggregation: gradient sums by pairs of features and their bins, from which the driver
reads the root's split and those below it; the sums are some thousand rows whatever the number of URLs. The finished
trees are one SQL expression.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and is
judged by the trees; with no labelled URLs, or labels of one kind, the verdict is allow unless all
labels are block; repeated pages are judged alike; an empty table gives an empty one; other columns of pages,
whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Parts of a host that name what isn't wanted.
SEEDS = tuple("adult bet bets betting casino casinos cialis dating escort escorts jackpot loan loans lottery payday pharma pill pills poker porn replica sex slots viagra xxx".split())
BINS = 16
TREES = 12
RATE = 0.4
#: Labelled URLs that the trees are grown from, at most (on average of the draw by hash).
TRAIN_ROWS = 500_000
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._/?=&%#:"


def lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    there = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    after = F.substr(url, F.instr(url, "://") + F.lit(3))
    host = lower(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1))
    tail = F.substr(after, F.length(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)) + F.lit(1))
    path = F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)
    return F.when(there, host).otherwise(F.lit("")), F.when(there, path).otherwise(F.lit(""))


def ruled(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Bins (0 to BINS-1) of the lexical features."""
    u = lower(F.coalesce(url, F.lit("")))
    n = F.length(u)
    counts = [(n - F.length(F.replace(u, F.lit(c), F.lit("")))).cast("double") for c in ALPHABET]
    known = sum(counts[1:], counts[0])
    entropy = sum((F.when(c > 0, c * F.log2(c)).otherwise(0.0) for c in counts[1:]), F.when(counts[0] > 0, counts[0] * F.log2(counts[0])).otherwise(0.0))
    entropy = F.when(known > 0, F.log2(known) - entropy / known).otherwise(0.0)
    digits = sum(counts[27:36], counts[26])
    query = F.when(F.instr(u, "?") > 0, F.substring_index(F.substring_index(u, "#", 1), "?", -1)).otherwise("")
    features = {
        "length": n / 8,
        "host_length": F.length(host) / 3,
        "depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "digit_ratio": F.when(n > 0, digits / n * 32).otherwise(0.0),
        "entropy": (entropy - 2.5) * 6,
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "labels": F.size(F.split(host, r"\.")),
        "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "last_segment": F.length(F.substring_index(path, "/", -1)),
        "first_segment": F.length(F.substring_index(F.substring_index(path, "/", 2), "/", -1)),
    }
    return {k: F.least(F.greatest(F.coalesce(F.floor(v), F.lit(0)), F.lit(0)), F.lit(BINS - 1)).cast("int") for k, v in features.items()}


SUFFIX = ("suffix_rate", "suffix_size")


def seeded(host: Column, seeds: tuple = SEEDS) -> Column:
    """1.0 where a part of the host is a seed, else 0.0."""
    return F.regexp_like(host, F.lit(rf"(^|[.-])({'|'.join(seeds)})([.-]|$)")).cast("double")


def _split(sums: dict[str, np.ndarray]) -> tuple[float, str, int] | None:
    """(gain, feature, bin) of the best split of a node. sums: for each feature, gradients and hessians by bin."""
    best = None
    for f, (g, h) in sums.items():
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        all_g, all_h = g.sum(), h.sum()
        gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
        b = int(gain.argmax())
        if gain[b] > 1e-6 + 1e-9 + (best[0] if best else 0.0):
            best = (float(gain[b]), f, b)
    return best


def _leaf(sums: dict[str, np.ndarray], rate: float) -> str:
    g, h = next(iter(sums.values()))
    return f"{rate * float(g.sum()) / (float(h.sum()) + 1)!r}D"


def _grown(cells: dict[tuple[str, str], np.ndarray], features: list[str], rate: float) -> str | None:
    """SQL of the tree of two levels that gradients and hessians by pairs of bins ask for."""

    def sums(side: slice = slice(None), of: str | None = None) -> dict[str, np.ndarray]:
        out = {}
        for f in features:
            if f == of or of is None:
                other = next(x for x in features if x != f)
                whole = (cells[f, other].sum(2) if (f, other) in cells else cells[other, f].sum(1)).copy()
                if of is not None:
                    keep = np.zeros_like(whole)
                    keep[:, side] = whole[:, side]
                    whole = keep
                out[f] = whole
            else:
                out[f] = cells[of, f][:, side].sum(1) if (of, f) in cells else cells[f, of][:, :, side].sum(2)
        return out

    root = _split(sums())
    if root is None:
        return None
    _, f, b = root
    sides = []
    for side in (slice(0, b + 1), slice(b + 1, None)):
        node = sums(side, f)
        below = _split(node)
        if below is None:
            sides.append(_leaf(node, rate))
            continue
        _, f2, b2 = below
        parts = [{f2: np.where(np.arange(BINS) <= b2, node[f2], 0.0)}, {f2: np.where(np.arange(BINS) > b2, node[f2], 0.0)}]
        sides.append(f"CASE WHEN {f2} <= {b2} THEN {_leaf(parts[0], rate)} ELSE {_leaf(parts[1], rate)} END")
    return f"CASE WHEN {f} <= {b} THEN {sides[0]} ELSE {sides[1]} END"


def boost(table: DataFrame, features: list[str], trees: int = TREES, rate: float = RATE) -> tuple[float, list[str]]:
    """table: features (bins), label (0.0/1.0), n (rows). Gives the base score and the trees as SQL; logistic loss."""
    total, ones = table.agg(F.sum("n"), F.sum(F.col("n") * F.col("label"))).first()
    if not total or not ones or ones == total:
        return (20.0 if total and ones == total else -20.0), []
    base = math.log(ones / (total - ones))
    grown: list[str] = []
    pairs = list(combinations(features, 2))
    stack = f"stack({len(pairs)}, {', '.join(f'{i}, {f}, {g}' for i, (f, g) in enumerate(pairs))}) as (pair, x, y)"
    for _ in range(trees):
        score = " + ".join([f"{base!r}D", *[f"({t})" for t in grown]])
        known = table.withColumn("p", F.expr(f"1 / (1 + exp(-({score})))")).selectExpr(*features, "n * (label - p) as g", "n * p * (1 - p) as h")
        sums = known.selectExpr("g", "h", stack).groupBy("pair", "x", "y").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        cells = {p: np.zeros((2, BINS, BINS)) for p in pairs}
        for r in sums.collect():  # at most pairs of features times BINS * BINS
            cells[pairs[r["pair"]]][:, r["x"], r["y"]] = r["g"], r["h"]
        tree = _grown(cells, features, rate)
        if tree is None:
            break
        grown.append(tree)
    return base, grown


def judge(pages: DataFrame, rules: tuple = RULES, labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' chance of block) of each row of pages.

    labelled: a table of url and label (1: block); without it, all URLs of pages, labelled by SEEDS.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")

    def seen(df: DataFrame) -> DataFrame:
        host, path = parts(F.col("url"))
        df = df.withColumn("host", host).withColumn("path", path)
        for k, v in lexical(F.col("url"), F.col("host"), F.col("path")).items():
            df = df.withColumn(k, v)
        return df.withColumn("suffix", F.substring_index("host", ".", -1))

    rows = seen(pages.select("page_id", "url")).withColumn("ruled", ruled(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = rows.withColumn("label", seeded(F.col("host")))
    else:
        known = seen(labelled.select("url", "label")).withColumn("label", F.col("label").cast("double"))
    names = list(lexical(F.col("url"), F.col("host"), F.col("path")))
    binned = scratch.cut(known.groupBy("suffix", *names, "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("url")).alias("draw")), "labelled")
    n = binned.agg(F.sum("n")).first()[0] or 0
    # Suffix statistics over all labelled URLs; the trees' own rows are drawn by hash where there are too many.
    suffixes = binned.groupBy("suffix").agg(F.sum(F.col("n") * F.col("label")).alias("ones"), F.sum("n").alias("all")).select(
        F.col("suffix").alias("_suffix"),
        F.least(F.floor((F.col("ones") + 1) / (F.col("all") + 2) * BINS), F.lit(BINS - 1)).cast("int").alias("suffix_rate"),
        F.least(F.floor(F.log2(F.col("all") + 1)), F.lit(BINS - 1)).cast("int").alias("suffix_size"),
    )
    suffixes = scratch.cut(suffixes, "suffixes")

    def with_suffix(df: DataFrame) -> DataFrame:
        joined = df.join(F.broadcast(suffixes) if n_suffixes <= 100_000 else suffixes, F.col("suffix") == F.col("_suffix"), "left")
        return joined.withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(BINS // 2))).withColumn("suffix_size", F.coalesce("suffix_size", F.lit(0)))

    n_suffixes = suffixes.count()
    drawn = binned if n <= train_rows else binned.where(F.pmod(F.col("draw"), F.lit(1 << 20)) < int(train_rows / n * (1 << 20)))
    features = [*names, *SUFFIX]
    table = scratch.cut(with_suffix(drawn).groupBy(*features, "label").agg(F.sum("n").cast("double").alias("n")).coalesce(4), "bins")
    base, trees = boost(table, features)
    score = F.expr("1 / (1 + exp(-(" + " + ".join([f"{base!r}D", *[f"({t})" for t in trees]]) + ")))")
    out = with_suffix(rows).withColumn("score", score)
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), F.round("score", 9).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
