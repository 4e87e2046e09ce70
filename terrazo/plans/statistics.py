"""Queries: rank statistics, agreement, spatial statistics, composites, kernels, streaming."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrazo.functions import arrays as K
from terrazo.functions import scalars as S
from terrazo.operators import analytics as A
from terrazo.operators import composite as C
from terrazo.operators import spatial as P

from .registry import query, r, table

_RX = "(rank() OVER (PARTITION BY g ORDER BY x)+(count(*) OVER (PARTITION BY g,x)-1)/2.0)"
_RY = "(rank() OVER (PARTITION BY g ORDER BY y)+(count(*) OVER (PARTITION BY g,y)-1)/2.0)"


@query("spearman", f"SELECT g AS p_type, count(*) n, round(corr(rx,ry),5) rho FROM (SELECT g, {_RX} rx, {_RY} ry FROM (SELECT p_type g, p_size x, p_retailprice y FROM part)) GROUP BY 1")
def spearman(spark, d):
    return A.spearman(table(spark, d, "part", "p_type", "p_size", "p_retailprice"), "p_size", "p_retailprice", ["p_type"], 10).select("p_type", "n", r("rho", 5).alias("rho"))


_L3 = "SELECT 1 g, o_orderkey id, o_totalprice a, o_custkey b, o_orderkey%97 c FROM orders"


def _three(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a"), F.col("o_custkey").alias("b"), (F.col("o_orderkey") % 97).alias("c"))


def _ranks(cols="abc"):
    return ", ".join(f"rank() OVER (ORDER BY {x})+(count(*) OVER (PARTITION BY {x})-1)/2.0 r{x}" for x in cols)


_MATRIX = f"WITH t AS ({_L3}), k AS (SELECT {_ranks()} FROM t), m AS (SELECT corr(ra,rb) ab, corr(ra,rc) ac, corr(rb,rc) bc FROM k)"


def _matrix(spark, d) -> DataFrame:
    t = A.ranked(_three(spark, d), {f"r{c}": c for c in "abc"})
    return t.agg(F.corr("ra", "rb").alias("ab"), F.corr("ra", "rc").alias("ac"), F.corr("rb", "rc").alias("bc"))


@query("spearman_matrix", _MATRIX + " SELECT round(ab,5) ab, round(ac,5) ac, round(bc,5) bc FROM m")
def spearman_matrix(spark, d):
    return _matrix(spark, d).select(r("ab", 5).alias("ab"), r("ac", 5).alias("ac"), r("bc", 5).alias("bc"))


@query("derive_weights", _MATRIX + ", w AS (SELECT 1/(1+abs(ab)+abs(ac)) a, 1/(1+abs(ab)+abs(bc)) b, 1/(1+abs(ac)+abs(bc)) c FROM m) SELECT round(a/(a+b+c),5) a, round(b/(a+b+c),5) b, round(c/(a+b+c),5) c FROM w")
def derive_weights(spark, d):
    m = _matrix(spark, d).select(*[F.abs(c).alias(c) for c in ("ab", "ac", "bc")])
    w = m.select((1 / (1 + F.col("ab") + F.col("ac"))).alias("a"), (1 / (1 + F.col("ab") + F.col("bc"))).alias("b"), (1 / (1 + F.col("ac") + F.col("bc"))).alias("c"))
    t = F.col("a") + F.col("b") + F.col("c")
    return w.select(*[r(F.col(x) / t, 5).alias(x) for x in "abc"])


@query("derive_weights_offdiag", _MATRIX + ", w AS (SELECT 1/(abs(ab)+abs(ac)) a, 1/(abs(ab)+abs(bc)) b, 1/(abs(ac)+abs(bc)) c FROM m) SELECT round(a/(a+b+c),6) a, round(b/(a+b+c),6) b, round(c/(a+b+c),6) c FROM w")
def derive_weights_offdiag(spark, d):
    m = _matrix(spark, d).select(*[F.abs(c).alias(c) for c in ("ab", "ac", "bc")])
    w = m.select((1 / (F.col("ab") + F.col("ac"))).alias("a"), (1 / (F.col("ab") + F.col("bc"))).alias("b"), (1 / (F.col("ac") + F.col("bc"))).alias("c"))
    t = F.col("a") + F.col("b") + F.col("c")
    return w.select(*[r(F.col(x) / t, 6).alias(x) for x in "abc"])


@query("partial_spearman", _MATRIX + " SELECT round((ab-ac*bc)/sqrt((1-ac*ac)*(1-bc*bc)),5) rho FROM m")
def partial_spearman(spark, d):
    return A.partial_spearman(_three(spark, d), "a", "b", "c").select(r("rho", 5).alias("rho"))


@query("ols_residual", "WITH f AS (SELECT regr_slope(p_retailprice, ln(p_size)) b, regr_intercept(p_retailprice, ln(p_size)) a, count(*) n FROM part) SELECT p_partkey, CASE WHEN n>30 THEN round(p_retailprice-(a+b*ln(p_size)),6) END resid FROM part, f")
def ols_residual(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", F.log("p_size").alias("x"))
    return A.ols_residual(p, "p_retailprice", "x", "resid").select("p_partkey", r("resid").alias("resid"))


_KW = """, q AS (SELECT *, rank() OVER (ORDER BY v)+(count(*) OVER (PARTITION BY v)-1)/2.0 r FROM s), t AS (SELECT sum(c*c*c-c) ties FROM (SELECT count(*)::DOUBLE c FROM q GROUP BY v)), g AS (SELECT sum(r) rs, count(*) ng FROM q GROUP BY grp), a AS (SELECT count(*) k, sum(ng)::DOUBLE n, sum(rs*rs/ng) q FROM g),
 h AS (SELECT k, n, (12/(n*(n+1))*q-3*(n+1))/(1-ties/(n*n*n-n)) h FROM a, t) SELECT k, CAST(n AS BIGINT) n, round(h,6) h, round((h-k+1)/(n-k),6) epsilon2 FROM h"""


@query("kruskal", "WITH s AS (SELECT c_mktsegment grp, c_acctbal v FROM customer)" + _KW)
def kruskal(spark, d):
    return A.kruskal(table(spark, d, "customer", "c_mktsegment", "c_acctbal"), "c_acctbal", "c_mktsegment").select("k", "n", r("h").alias("h"), r("epsilon2", 6).alias("epsilon2"))


@query("eta_squared", "WITH s AS (SELECT o_orderpriority grp, round(o_totalprice/1000) v FROM orders)" + _KW)
def eta_squared(spark, d):
    return A.kruskal(table(spark, d, "orders").select("o_orderpriority", F.round(F.col("o_totalprice") / 1000).alias("v")), "v", "o_orderpriority").select("k", "n", r("h").alias("h"), r("epsilon2", 6).alias("epsilon2"))


@query("mann_whitney", "WITH q AS (SELECT c_mktsegment='BUILDING' f, rank() OVER (ORDER BY c_acctbal)+(count(*) OVER (PARTITION BY c_acctbal)-1)/2.0 r FROM customer), a AS (SELECT sum(CASE WHEN f THEN r END) rs, count_if(f) n1, count_if(NOT f) n2 FROM q), u AS (SELECT n1, n2, rs-n1*(n1+1)/2.0 u FROM a) SELECT n1, n2, round(u,2) u, round((u-n1*n2/2.0)/sqrt(n1::DOUBLE*n2*(n1+n2+1)/12.0),6) z FROM u")
def mann_whitney(spark, d):
    return A.mann_whitney(table(spark, d, "customer"), "c_acctbal", F.col("c_mktsegment") == "BUILDING").select("n1", "n2", r("u", 2).alias("u"), r("z").alias("z"))


_KNN = "WITH p AS (SELECT vec_id id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, label FROM embeddings), e AS (SELECT src, dst, k, d2 FROM (SELECT a.id src, b.id dst, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) d2, row_number() OVER (PARTITION BY a.id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.id) k FROM p a JOIN p b ON a.id<>b.id) WHERE k<=8)"


def _points(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), "label")


@query("join_knn", _KNN + " SELECT src, dst, CAST(k AS INT) rank, round(d2,6) d2 FROM e")
def join_knn(spark, d):
    return P.knn(_points(spark, d), 8, 0.3).select("src", "dst", "rank", r("d2", 6).alias("d2"))


@query("morans_i", _KNN + ", z AS (SELECT id, label-avg(label) OVER () z FROM p) SELECT round((SELECT count(*) FROM z)/count(*)*sum(a.z*b.z)/(SELECT sum(z*z) FROM z),6) morans_i, (SELECT count(*) FROM z) n, count(*) w FROM e JOIN z a ON a.id=src JOIN z b ON b.id=dst")
def morans_i(spark, d):
    p = _points(spark, d).withColumn("v", F.col("label").cast("double"))
    return A.morans_i(P.knn(p, 8, 0.3, carry="v").select("src", "dst", "v"), p.select("id", "v")).select(r("morans_i", 6).alias("morans_i"), "n", "w")


@query("perm_pvalue")
def perm_pvalue(spark, d):
    """Every customer and 199 permutations."""
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y"))
    return A.perm_pvalue(t, 199).select(r("p").alias("p"), "reps")


_KAPPA = ", n AS (SELECT count(*)::DOUBLE n, avg((a=b)::INT) po FROM s), e AS (SELECT sum(x.c::DOUBLE*y.c) s FROM (SELECT a k, count(*) c FROM s GROUP BY 1) x JOIN (SELECT b k, count(*) c FROM s GROUP BY 1) y USING(k)) SELECT round(po,5) po, round(s/(n*n),5) pe, round((po-s/(n*n))/nullif(1-s/(n*n),0),5) kappa FROM n, e"


@query("cohen_kappa", "WITH s AS (SELECT quality a, toxic b FROM labels)" + _KAPPA)
def cohen_kappa(spark, d):
    return A.kappa(table(spark, d, "labels"), "quality", "toxic").select(r("po", 5).alias("po"), r("pe", 5).alias("pe"), r("kappa", 5).alias("kappa"))


@query("kappa_matrix", """WITH l AS (SELECT p_partkey id, unnest(['a','b','c']) m, unnest([p_size%3, p_partkey%3, (p_size+p_partkey)%3]) v FROM part), s AS (SELECT x.m a, y.m b, x.v va, y.v vb FROM l x JOIN l y ON x.id=y.id AND x.m<y.m), n AS (SELECT a, b, count(*)::DOUBLE n, avg((va=vb)::INT) po FROM s GROUP BY 1,2),
 e AS (SELECT x.a, x.b, sum(x.c::DOUBLE*y.c) s FROM (SELECT a, b, va k, count(*) c FROM s GROUP BY 1,2,3) x JOIN (SELECT a, b, vb k, count(*) c FROM s GROUP BY 1,2,3) y ON x.a=y.a AND x.b=y.b AND x.k=y.k GROUP BY 1,2) SELECT n.a, n.b, round((po-s/(n*n))/nullif(1-s/(n*n),0),5) kappa FROM n JOIN e ON n.a=e.a AND n.b=e.b""")
def kappa_matrix(spark, d):
    p = table(spark, d, "part")
    labels = {"a": F.col("p_size") % 3, "b": F.col("p_partkey") % 3, "c": (F.col("p_size") + F.col("p_partkey")) % 3}
    w = p.select(*[v.cast("long").alias(k) for k, v in labels.items()])
    out = None
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        k = A.kappa(w, x, y).select(F.lit(x).alias("a"), F.lit(y).alias("b"), r("kappa", 5).alias("kappa"))
        out = k if out is None else out.unionByName(k)
    return out


@query("binary_kappa", "SELECT round(avg((a=b)::INT),5) po, round((avg((a=b)::INT)-(avg(a::INT)*avg(b::INT)+(1-avg(a::INT))*(1-avg(b::INT))))/nullif(1-(avg(a::INT)*avg(b::INT)+(1-avg(a::INT))*(1-avg(b::INT))),0),5) kappa FROM (SELECT quality=1 a, toxic=1 b FROM labels)")
def binary_kappa(spark, d):
    a, b = F.col("quality"), F.col("toxic")
    po, x, y = F.avg((a == b).cast("int")), F.avg((a == 1).cast("int")), F.avg((b == 1).cast("int"))
    pe = x * y + (1 - x) * (1 - y)
    return table(spark, d, "labels").agg(r(po, 5).alias("po"), r(F.try_divide(po - pe, 1 - pe), 5).alias("kappa"))


@query("recall_lift", "SELECT o_orderpriority cls, round(avg((o_custkey%5=g)::INT),5) recall, round(avg((o_custkey%5=g)::INT)/(SELECT avg((o_custkey%5=0)::INT) FROM orders),5) lift FROM (SELECT *, CAST(left(o_orderpriority,1) AS INT)-1 g FROM orders) GROUP BY 1")
def recall_lift(spark, d):
    o = table(spark, d, "orders").withColumn("g", F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    m = o.agg(F.avg((F.col("o_custkey") % 5 == 0).cast("int")).alias("m"))
    hit = F.avg((F.col("o_custkey") % 5 == F.col("g")).cast("int"))
    return o.groupBy(F.col("o_orderpriority").alias("cls")).agg(hit.alias("h")).crossJoin(m).select("cls", r("h", 5).alias("recall"), r(F.col("h") / F.col("m"), 5).alias("lift"))


@query("stratified_accuracy", """WITH t AS (SELECT p_size%4 pred, p_partkey%4 truth, p_retailprice a FROM part), s AS (SELECT pred, sum(a)/sum(sum(a)) OVER () share FROM t GROUP BY 1), c AS (SELECT pred, truth, count(*)::DOUBLE/sum(count(*)) OVER (PARTITION BY pred) p FROM t GROUP BY 1,2),
 w AS (SELECT truth c, sum(share*p) w FROM s JOIN c USING(pred) GROUP BY 1), rc AS (SELECT truth c, avg((pred=truth)::INT) r FROM t GROUP BY 1) SELECT round(sum(w*r)/sum(w),5) accuracy, round(max(w),5) majority FROM w JOIN rc USING(c)""")
def stratified_accuracy(spark, d):
    t = table(spark, d, "part").select((F.col("p_size") % 4).alias("pred"), (F.col("p_partkey") % 4).alias("truth"), F.col("p_retailprice").alias("a"))
    tot = F.broadcast(t.agg(F.sum("a").alias("t")))
    s = t.groupBy("pred").agg(F.sum("a").alias("a"), F.count(F.lit(1)).alias("n")).crossJoin(tot).select("pred", (F.col("a") / F.col("t")).alias("share"), "n")
    c = t.groupBy("pred", "truth").agg(F.count(F.lit(1)).alias("k")).join(s, "pred")
    w = c.groupBy("truth").agg(F.sum(F.col("share") * F.col("k") / F.col("n")).alias("w"))
    rc = t.groupBy("truth").agg(F.avg((F.col("pred") == F.col("truth")).cast("int")).alias("rc"))
    return w.join(rc, "truth").agg(r(F.sum(F.col("w") * F.col("rc")) / F.sum("w"), 5).alias("accuracy"), r(F.max("w"), 5).alias("majority"))


@query("conf_split", "SELECT p_retailprice>m AS above, count(*) n, round(avg((p_size%3=0)::INT),5) accuracy FROM part, (SELECT median(p_retailprice) m FROM part) GROUP BY 1")
def conf_split(spark, d):
    p = table(spark, d, "part")
    return p.crossJoin(F.broadcast(p.agg(F.median("p_retailprice").alias("m")))).groupBy((F.col("p_retailprice") > F.col("m")).alias("above")).agg(F.count(F.lit(1)).alias("n"), r(F.avg((F.col("p_size") % 3 == 0).cast("int")), 5).alias("accuracy"))


_DEC = "WITH e AS (SELECT list_distinct(quantile_cont(p_retailprice,[0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1])) e FROM part), b AS (SELECT *, greatest(len(list_filter(e, lambda x: x<p_retailprice))-1,0) bin FROM part, e)"


@query("ipw_estimate", _DEC + ", f AS (SELECT bin, avg((p_partkey%3=0)::INT) f FROM b GROUP BY 1) SELECT round(sum(p_size/f)/sum(1/f),5) estimate FROM b JOIN f USING(bin) WHERE p_partkey%3=0 AND f>0")
def ipw_estimate(spark, d):
    b = A.qcut(table(spark, d, "part"), "p_retailprice", 10, "bin")
    f = b.groupBy("bin").agg(F.avg((F.col("p_partkey") % 3 == 0).cast("int")).alias("f"))
    return b.where("p_partkey % 3 = 0").join(f, "bin").where("f > 0").agg(r(F.sum(F.col("p_size") / F.col("f")) / F.sum(1 / F.col("f")), 5).alias("estimate"))


@query("calibration_bins", _DEC + " SELECT bin, count(*) n, round(avg(p_retailprice)/2500,5) p, round(avg((p_size>25)::INT),5) hit, round(avg((p_size>25)::INT)-avg(p_retailprice)/2500,5) gap FROM b GROUP BY 1")
def calibration_bins(spark, d):
    p, h = F.avg("p_retailprice") / 2500, F.avg((F.col("p_size") > 25).cast("int"))
    return A.qcut(table(spark, d, "part"), "p_retailprice", 10, "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r(p, 5).alias("p"), r(h, 5).alias("hit"), r(h - p, 5).alias("gap"))


@query("posterior_moments", """WITH k AS (SELECT vec_id, list_transform(embedding[1:3], lambda v: exp(v::DOUBLE)) k FROM embeddings), p AS (SELECT vec_id, list_transform(k, lambda v: v/list_sum(k)) p FROM k), m AS (SELECT vec_id, p[1]*1.2+p[2]*2.5+p[3]*0.9 e, p[1]*1.44+p[2]*6.25+p[3]*0.81 s FROM p) SELECT vec_id, round(e,5) e, round(sqrt(greatest(s-e*e,0)),5) sd FROM m""")
def posterior_moments(spark, d):
    a = F.array(F.lit(1.2), F.lit(2.5), F.lit(0.9))
    p = table(spark, d, "embeddings").select("vec_id", S.softmax(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))).alias("p"))
    dot = lambda f: F.aggregate(F.zip_with("p", a, f), F.lit(0.0), lambda s, x: s + x)
    e, s = dot(lambda x, y: x * y), dot(lambda x, y: x * y * y)
    return p.select("vec_id", r(e, 5).alias("e"), r(F.sqrt(F.greatest(s - e * e, F.lit(0.0))), 5).alias("sd"))


@query("apy_consistency", "SELECT crop, round(1000.0*prod/area/kg,6) ratio, 1000.0*prod/area/kg BETWEEN 0.85 AND 1.15 ok, round(170.0*prod/area/kg,6) bales FROM (VALUES ('Rice',100,250,2500),('Cotton',1000,2800,480)) t(crop,area,prod,kg)")
def apy_consistency(spark, d):
    t = spark.createDataFrame([("Rice", 100, 250, 2500), ("Cotton", 1000, 2800, 480)], "crop string, area int, prod int, kg int")
    q = 1000.0 * F.col("prod") / F.col("area") / F.col("kg")
    return t.select("crop", r(q).alias("ratio"), q.between(0.85, 1.15).alias("ok"), r(170.0 * F.col("prod") / F.col("area") / F.col("kg")).alias("bales"))


@query("se_propagation", "WITH z AS (SELECT l_partkey, count(*) n, stddev_pop(l_extendedprice)/avg(l_extendedprice) cv FROM lineitem GROUP BY 1) SELECT round(median(cv/sqrt(n)),5) se, round(median(2*cv/sqrt(n)),5) half, round(avg((10/ln(10)*cv/sqrt(n)*25>5)::INT),5) share FROM z")
def se_propagation(spark, d):
    z = table(spark, d, "lineitem").groupBy("l_partkey").agg((F.stddev_pop("l_extendedprice") / F.avg("l_extendedprice") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return z.agg(r(F.median("se"), 5).alias("se"), r(F.median(2 * F.col("se")), 5).alias("half"), r(F.avg((10 / F.log(F.lit(10.0)) * F.col("se") * 25 > 5).cast("int")), 5).alias("share"))


@query("sign_check", f"SELECT bool_and(rho>0) ok, count(*) classes FROM (SELECT g, corr(rx,ry) rho FROM (SELECT g, {_RX} rx, {_RY} ry FROM (SELECT p_type g, p_size x, p_retailprice y FROM part)) GROUP BY 1)")
def sign_check(spark, d):
    return A.spearman(table(spark, d, "part"), "p_size", "p_retailprice", ["p_type"]).agg(F.bool_and(F.col("rho") > 0).alias("ok"), F.count(F.lit(1)).alias("classes"))


@query("gate_not_relabel", f"SELECT max(abs(rho))<0.99 ok FROM (SELECT g, corr(rx,ry) rho FROM (SELECT g, {_RX} rx, {_RY} ry FROM (SELECT p_type g, p_size x, p_retailprice y FROM part)) GROUP BY 1)")
def gate_not_relabel(spark, d):
    return A.spearman(table(spark, d, "part"), "p_size", "p_retailprice", ["p_type"]).agg((F.max(F.abs("rho")) < 0.99).alias("ok"))


# --- spatial


@query("shoelace_centroid", "WITH t AS (SELECT s_suppkey id, s_suppkey%7+1.0 w, s_nationkey+1.0 h, s_suppkey*1.0 x, s_nationkey*2.0 y FROM supplier) SELECT id, round(w*h,5) area, round(x+w/2,5) cx, round(y+h/2,5) cy FROM t")
def shoelace_centroid(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 7 + 1.0).alias("w"), (F.col("s_nationkey") + 1.0).alias("h"), F.col("s_suppkey").cast("double").alias("x0"), (F.col("s_nationkey") * 2.0).alias("y0"))
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    ring = s.select("id", F.lit(0).alias("part"), F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), (F.col("x0") + a * F.col("w")).alias("x"), (F.col("y0") + b * F.col("h")).alias("y")) for i, (a, b) in enumerate(corners)])).alias("v"))
    return P.shoelace_centroid(ring.select("id", "part", "v.seq", "v.x", "v.y")).select("id", r("area", 5).alias("area"), r("cx", 5).alias("cx"), r("cy", 5).alias("cy"))


@query("join_point_in_polygon", "SELECT vec_id AS id, b.k AS poly FROM embeddings, (VALUES (1,-0.5,-0.5,0.2,0.3),(2,0.0,0.0,1.0,0.8)) b(k,x0,y0,x1,y1) WHERE embedding[1]>=x0 AND embedding[1]<x1 AND embedding[2]>=y0 AND embedding[2]<y1")
def join_point_in_polygon(spark, d):
    rows = []
    for k, x0, y0, x1, y1 in ((1, -0.5, -0.5, 0.2, 0.3), (2, 0.0, 0.0, 1.0, 0.8)):
        v = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        rows += [(k, *a, *b) for a, b in zip(v, v[1:] + v[:1], strict=True)]
    edges = spark.createDataFrame(rows, "poly int, x1 double, y1 double, x2 double, y2 double")
    return P.point_in_polygon(_points(spark, d).drop("label"), edges, 0.5)


@query("knn_impute", """WITH p AS (SELECT vec_id id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, label g, CASE WHEN vec_id%9<>0 THEN round(50+20*embedding[3]::DOUBLE,6) END v FROM embeddings), n AS (SELECT src, median(v) m, count(*) c FROM (SELECT a.id src, b.v, row_number() OVER (PARTITION BY a.id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.id) k FROM p a JOIN p b ON a.g=b.g AND a.v IS NULL AND b.v IS NOT NULL) WHERE k<=5 GROUP BY 1), gm AS (SELECT g, median(v) m FROM p WHERE v IS NOT NULL GROUP BY 1)
 SELECT id, v IS NULL imputed, round(coalesce(v, CASE WHEN c>=3 THEN n.m END, gm.m, 50),6) filled FROM p LEFT JOIN n ON src=id LEFT JOIN gm USING(g)""")
def knn_impute(spark, d):
    e = F.col("embedding")
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), F.col("label").alias("g"), F.when(F.col("vec_id") % 9 != 0, F.round(50 + 20 * e[2].cast("double"), 6)).alias("v"))
    return C.knn_impute(p, "id", "g", "v").select("id", "imputed", r("filled").alias("filled"))


# --- composites

_W = [("Rice", "f1", 2.2), ("Rice", "f2", -0.4), ("Cotton", "f1", -0.6), ("Cotton", "f3", 0.7), ("Maize", "f2", 0.8), ("Maize", "f3", -0.5)]


@query("crop_evidence", "SELECT vec_id, round(2.2*embedding[1]-0.4*embedding[2],5) rice, round(-0.6*embedding[1]+0.7*embedding[3],5) cotton, round(0.8*embedding[2]-0.5*embedding[3],5) maize FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) embedding FROM embeddings)")
def crop_evidence(spark, d):
    e = C.evidence(_features(spark, d), _W, "vec_id")
    return e.select("vec_id", *[r(F.col("e")[i], 5).alias(c) for i, c in enumerate(("rice", "cotton", "maize"))])


def _features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i + 1}") for i in range(3)])


@query("leave_channel_out", "SELECT vec_id, round(e1-greatest(e2,e3),5) margin FROM (SELECT vec_id, -0.4*embedding[2] e1, 0.7*embedding[3] e2, 0.8*embedding[2]-0.5*embedding[3] e3 FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) embedding FROM embeddings))")
def leave_channel_out(spark, d):
    e = C.evidence(_features(spark, d), [w for w in _W if w[1] != "f1"], "vec_id")
    return e.select("vec_id", r(F.col("e")[0] - F.greatest(F.col("e")[1], F.col("e")[2]), 5).alias("margin"))


@query("assign_crop")
def assign_crop(spark, d):
    """Evidence, softmax, prior and largest class; the loop runs in one task for each village."""
    e = C.evidence(_features(spark, d), _W, "vec_id").select(F.lit(1).alias("village"), "vec_id", S.softmax(F.col("e")).alias("p"), F.lit(1.0).alias("area"))
    q = C.fit_prior(e, "village", "vec_id", [0.2, 0.5, 0.3])
    return q.select("vec_id", S.argmax_label(F.col("q"), ["Rice", "Cotton", "Maize"]).alias("crop"), r(F.array_max("q")).alias("confidence"))


_HEALTH = """WITH p AS (SELECT p_partkey, p_type g, CASE WHEN p_size%11=0 THEN NULL ELSE p_retailprice END raw FROM part), c AS (SELECT g, median(raw) c, count(raw) n FROM p GROUP BY 1), s AS (SELECT p.g, any_value(c) c, any_value(n) n, 1.4826*median(abs(raw-c)) s FROM p JOIN c USING(g) GROUP BY 1),
 z AS (SELECT p_partkey, raw, n, (raw-c)/CASE WHEN s>0 THEN s ELSE 1 END z FROM p JOIN s USING(g))"""


@query("health_index", _HEALTH + f" SELECT p_partkey, CASE WHEN raw IS NULL THEN NULL WHEN n<5 THEN 50 ELSE round(100*({S.normal_cdf_sql('z')}),6) END health FROM z")
def health_index(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("g"), F.when(F.col("p_size") % 11 != 0, F.col("p_retailprice")).alias("raw"))
    return C.health_index(p, "raw", "g", "health").select("p_partkey", r("health").alias("health"))


@query("weighted_composite", "SELECT vec_id, round(0.5*coalesce(a,0)+0.3*b+0.2*c,5) total, round((coalesce(0.5*a,0)+0.3*b+0.2*c)/(CASE WHEN a IS NULL THEN 0 ELSE 0.5 END+0.3+0.2),5) present FROM (SELECT vec_id, CASE WHEN vec_id%4<>0 THEN embedding[1]::DOUBLE END a, embedding[2]::DOUBLE b, embedding[3]::DOUBLE c FROM embeddings)")
def weighted_composite(spark, d):
    a = F.when(F.col("vec_id") % 4 != 0, F.col("f1"))
    return _features(spark, d).select("vec_id", r(0.5 * F.coalesce(a, F.lit(0.0)) + 0.3 * F.col("f2") + 0.2 * F.col("f3"), 5).alias("total"), r(C.present_mean([(a, 0.5), (F.col("f2"), 0.3), (F.col("f3"), 0.2)]), 5).alias("present"))


@query("yield_to_date", """WITH p AS (SELECT c_custkey, c_mktsegment g, c_acctbal a, CASE WHEN c_custkey%6<>0 THEN c_nationkey*1.0 END b FROM customer), m AS (SELECT g, median(a) ca, median(b) cb, count(a) na, count(b) nb FROM p GROUP BY 1), s AS (SELECT p.g, any_value(ca) ca, any_value(cb) cb, any_value(na) na, any_value(nb) nb, 1.4826*median(abs(a-ca)) sa, 1.4826*median(abs(b-cb)) sb FROM p JOIN m USING(g) GROUP BY 1),
 z AS (SELECT c_custkey, b, CASE WHEN na<10 OR sa<=0 THEN 0 ELSE least(greatest((a-ca)/sa,-4),6) END za, CASE WHEN nb<10 OR sb<=0 THEN 0 ELSE least(greatest((b-cb)/sb,-4),6) END zb, c_custkey%100 h FROM p JOIN s USING(g))
 SELECT c_custkey, round(1500*least(greatest(0.8-0.15*least(greatest(za,-2),2)/2,0.15),1)*least(greatest(1+0.3*CASE WHEN b IS NOT NULL THEN least(greatest(zb,-2),2)/2 ELSE (h-50)/50.0 END,0.4),1.6)/1000,5) yield_t FROM z""")
def yield_to_date(spark, d):
    p = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("a"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_nationkey") * 1.0).alias("b"), (F.col("c_custkey") % 100).cast("double").alias("h"), F.lit(1500.0).alias("anchor"), F.lit(0.8).alias("base"))
    return C.yield_to_date(p, "g", "anchor", "base", "a", "b", "h", "yield_t").select("c_custkey", r("yield_t", 5).alias("yield_t"))


@query("ablation", f"""WITH t AS ({_L3}), v AS (SELECT id, g0 variant, wa*a+wb*b*100+wc*c*1000 s, a+b*100+c*1000 base FROM t, (VALUES ('full',1,1,1),('no_a',0,1,1),('no_b',1,0,1),('no_c',1,1,0)) w(g0,wa,wb,wc)), k AS (SELECT variant, rank() OVER (PARTITION BY variant ORDER BY s)+(count(*) OVER (PARTITION BY variant, s)-1)/2.0 x, rank() OVER (PARTITION BY variant ORDER BY base)+(count(*) OVER (PARTITION BY variant, base)-1)/2.0 y FROM v) SELECT variant, round(corr(x,y),5) rho FROM k GROUP BY 1""")
def ablation(spark, d):
    w = F.broadcast(spark.createDataFrame([("full", 1, 1, 1), ("no_a", 0, 1, 1), ("no_b", 1, 0, 1), ("no_c", 1, 1, 0)], "variant string, wa int, wb int, wc int"))
    v = _three(spark, d).crossJoin(w).withColumn("s", F.col("wa") * F.col("a") + F.col("wb") * F.col("b") * 100 + F.col("wc") * F.col("c") * 1000).withColumn("base", F.col("a") + F.col("b") * 100 + F.col("c") * 1000)
    return A.spearman(v, "s", "base", ["variant"]).select("variant", r("rho", 5).alias("rho"))


@query("spatial_holdout", "WITH p AS (SELECT vec_id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE a, embedding[3]::DOUBLE b, label FROM embeddings), h AS (SELECT *, x>(SELECT median(x) FROM p) east FROM p) SELECT east, count(*) n, round(corr(a,label),5) ca, round(corr(b,label),5) cb FROM h GROUP BY 1")
def spatial_holdout(spark, d):
    p = _features(spark, d)
    h = p.crossJoin(F.broadcast(p.agg(F.median("f1").alias("m")))).withColumn("east", F.col("f1") > F.col("m"))
    return h.groupBy("east").agg(F.count(F.lit(1)).alias("n"), r(F.corr("f2", "label"), 5).alias("ca"), r(F.corr("f3", "label"), 5).alias("cb"))


@query("synth_truth", "SELECT CAST(floor(p_size/10) AS BIGINT) stratum, count(*) n, count_if(u<0.3) errors FROM (SELECT p_size, ('0x'||left(md5('t|'||p_partkey),8))::BIGINT/4294967296.0 u FROM part) GROUP BY 1")
def synth_truth(spark, d):
    u = F.conv(F.substring(A.md5_order("t", F.col("p_partkey")), 1, 8), 16, 10).cast("long") / 4294967296.0
    return table(spark, d, "part").select(F.floor(F.col("p_size") / 10).alias("stratum"), u.alias("u")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("u") < 0.3).alias("errors"))


@query("mrf_icm")
def mrf_icm(spark, d):
    p = _features(spark, d).select(F.lit(1).alias("village"), "vec_id", F.col("f1").alias("x"), F.col("f2").alias("y"), F.array("f1", "f2", "f3").alias("f"), S.softmax(F.array("f1", "f2", "f3")).alias("p"), (1.0 + F.col("vec_id") % 5).alias("area"))
    return C.mrf_labels(p, "village", "vec_id", [0.5, 0.3, 0.2]).select("vec_id", "label")


@query("blocked_cv")
def blocked_cv(spark, d):
    """Accuracy of a forest on spatial folds made by k-means; MLlib, so values are not those of another library."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    f = VectorAssembler(inputCols=["f1", "f2"], outputCol="xy").transform(_features(spark, d))
    f = VectorAssembler(inputCols=["f1", "f2", "f3"], outputCol="features").transform(f)
    f = KMeans(k=3, seed=1, featuresCol="xy", predictionCol="fold").fit(f).transform(f)
    out = None
    for k in range(3):
        m = RandomForestClassifier(numTrees=10, maxDepth=4, seed=1, labelCol="label").fit(f.where(F.col("fold") != k))
        s = m.transform(f.where(F.col("fold") == k)).agg(F.lit(k).alias("fold"), F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy"))
        out = s if out is None else out.unionByName(s)
    return out


# --- kernels


@query("wcm_invert")
def wcm_invert(spark, d):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        v, flag = K.wcm_invert(b["power"].to_numpy(float), 0.02, 0.3, np.full(len(b), 0.1), 35.0)
        return pd.DataFrame({"p_partkey": b["p_partkey"], "vwc": v, "flag": flag})

    p = table(spark, d, "part").select("p_partkey", S.wcm_forward(F.col("p_size") / 5.0, 0.02, 0.3, F.lit(0.1), 35.0).alias("power"))
    return C.mapped(p, run, "p_partkey long, vwc double, flag string")


@query("coherence_controls")
def coherence_controls(spark, d):
    """Self, shifted and independent pairs of synthetic blocks, one row for each block."""
    def run(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k in b["id"]:
            rng = np.random.default_rng(int(k))
            z, o = (rng.normal(size=(64, 64)) + 1j * rng.normal(size=(64, 64)) for _ in range(2))
            dy, dx = K.offset(z, K.fourier_shift(z, 3, -5))
            rows.append((k, float(K.coherence(z, z).mean()), float(K.coherence(z, o).mean()), dy, dx, float(K.sublook_coherence(z).mean()), float(K.glcm_entropy(np.abs(z), np.ones(z.shape, bool)))))
        return pd.DataFrame(rows, columns=["id", "self", "null", "dy", "dx", "sublook", "glcm"])

    return C.mapped(spark.range(8), run, "id long, self double, null double, dy double, dx double, sublook double, glcm double")


@query("spearman_pvalue")
def spearman_pvalue(spark, d):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        return b.assign(p=[K.student_p(x, n) for x, n in zip(b["rho"], b["n"], strict=True)])

    s = A.spearman(table(spark, d, "part"), "p_size", "p_retailprice", ["p_type"]).select("p_type", "n", "rho")
    return C.mapped(s, run, "p_type string, n long, rho double, p double")


def _cells(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rr"), F.col("l_linenumber").alias("cc"), "l_extendedprice", "l_quantity")


@query("landcover_masks")
def landcover_masks(spark, d):
    """Every order, price and quantity as the dates that a mask must hold on."""
    return P.landcover_masks(_cells(spark, d), ["l_extendedprice", "l_quantity"])


@query("landcover_candidates")
def landcover_candidates(spark, d):
    return P.landcover_candidates(_cells(spark, d), "l_extendedprice").select("rr", "cc", r("mean").alias("mean"), "dark", "bright")


@query("preview_coverage", "SELECT user_id, round(avg((value>0)::INT),5) share, avg((value>0)::INT)>=0.5 usable FROM events GROUP BY 1")
def preview_coverage(spark, d):
    s = F.avg((F.col("value") > 0).cast("int"))
    return table(spark, d, "events").groupBy("user_id").agg(r(s, 5).alias("share"), (s >= 0.5).alias("usable"))


@query("amplitude_percentiles", "SELECT event_type, round(quantile_cont(value,0.01),6) p1, round(median(value),6) med, round(quantile_cont(value,0.99),6) p99, count_if(value=0) zeros FROM events GROUP BY 1")
def amplitude_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(r(F.percentile("value", 0.01)).alias("p1"), r(F.median("value")).alias("med"), r(F.percentile("value", 0.99)).alias("p99"), F.count_if(F.col("value") == 0).alias("zeros"))


@query("nesz_check", "SELECT l_returnflag, round(quantile_cont(10*log10(l_extendedprice),0.001),6) floor_db, round(quantile_cont(10*log10(l_extendedprice),0.001)-29,6) gap FROM lineitem GROUP BY 1")
def nesz_check(spark, d):
    q = F.percentile(S.to_db(F.col("l_extendedprice")), 0.001)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(q).alias("floor_db"), r(q - 29).alias("gap"))


@query("occupied_band", "WITH p AS (SELECT event_type, hour(ts) bin, sum(value*value) pw FROM events GROUP BY 1,2) SELECT event_type, CAST(min(bin) AS INT) lo, CAST(max(bin) AS INT) hi FROM (SELECT *, max(pw) OVER (PARTITION BY event_type) mx FROM p) WHERE pw>=0.25*mx GROUP BY 1")
def occupied_band(spark, d):
    p = table(spark, d, "events").groupBy("event_type", F.hour("ts").alias("bin")).agg(F.sum(F.col("value") ** 2).alias("pw"))
    return p.withColumn("mx", F.max("pw").over(Window.partitionBy("event_type"))).where("pw >= 0.25 * mx").groupBy("event_type").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))


# --- streaming


@query("stream_trailing_sum")
def stream_trailing_sum(spark, d):
    """Sliding sums of the events as a stream: what the watermark has closed."""
    from terrazo.session import scratch_path
    from terrazo.streaming import trailing

    path = scratch_path(spark, "stream")
    return trailing.run_to_end(trailing.windowed_sums(trailing.read_events(spark, d)), f"{path}/out", f"{path}/checkpoint")


@query("wcm_sensitivity", "WITH s AS (SELECT p_partkey, k, 0.02*p_size/10.0*cos(radians(35))*(1-exp(-2*0.3*p_size/10.0/cos(radians(35))))+0.1*f*exp(-2*0.3*p_size/10.0/cos(radians(35))) p FROM part, (VALUES ('dry',0.92),('wet',1.08)) t(k,f)), b AS (SELECT p_partkey, avg(p) base FROM s GROUP BY 1) SELECT k AS scenario, round(median(p-base),8) delta FROM s JOIN b USING(p_partkey) GROUP BY 1")
def wcm_sensitivity(spark, d):
    t = F.broadcast(spark.createDataFrame([("dry", 0.92), ("wet", 1.08)], "scenario string, f double"))
    s = table(spark, d, "part").crossJoin(t).withColumn("p", S.wcm_forward(F.col("p_size") / 10.0, 0.02, 0.3, 0.1 * F.col("f"), 35.0))
    b = s.groupBy(F.col("p_partkey").alias("k")).agg(F.avg("p").alias("base"))
    return s.join(b, F.col("p_partkey") == F.col("k")).groupBy("scenario").agg(r(F.median(F.col("p") - F.col("base")), 8).alias("delta"))


@query("loo_poly")
def loo_poly(spark, d):
    """Leave-one-out error of polynomial surfaces of degree 1 to 3, one group of control points at a time."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, t = (rows[c].to_numpy(float) for c in ("x", "y", "t"))
        k = [n for n in (1, 2, 3) if len(rows) > 2 * (n + 1) * (n + 2) // 2]
        return pd.DataFrame({"label": rows["label"].iloc[0], "degree": k, "rmse": [float(np.sqrt((K.loo_errors(x, y, t, n) ** 2).mean())) for n in k]})

    e = F.col("embedding")
    g = table(spark, d, "embeddings").select("label", e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), e[2].cast("double").alias("t"))
    return g.groupBy("label").applyInPandas(run, f"label {dict(g.dtypes)['label']}, degree int, rmse double")
