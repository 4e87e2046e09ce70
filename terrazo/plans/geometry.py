"""Queries: polygons, control points, binary files, and trials of variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazo.functions import scalars as S
from terrazo.operators import analytics as A
from terrazo.operators import composite as C
from terrazo.operators import parcels as P
from terrazo.operators import warp as W
from terrazo.sources import geofiles as IO

from .registry import query, r, table

_A = "SELECT c_custkey id, c_custkey*37%1000+0.25::DOUBLE x0, c_custkey*53%700+0.25::DOUBLE y0, c_nationkey+10.5::DOUBLE w, c_custkey%13+8.5::DOUBLE h FROM customer"
_B = "SELECT s_suppkey id, (s_suppkey*97%1000)::DOUBLE x0, (s_suppkey*71%700)::DOUBLE y0, s_nationkey+60.0::DOUBLE w, 50.0::DOUBLE h FROM supplier"


def _box(df: DataFrame, key: str, x0, y0, w, h) -> DataFrame:
    d = df.select(F.col(key).alias("id"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), w.cast("double").alias("w"), h.cast("double").alias("h"))
    x, y = [F.col("x0"), F.col("x0") + F.col("w")], [F.col("y0"), F.col("y0") + F.col("h")]
    return d.withColumn("rings", F.array(F.array(*[F.array(x[i], y[j]) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])))


def _parcels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return _box(table(spark, d, "customer", "c_custkey", "c_nationkey"), "c_custkey", k * 37 % 1000 + 0.25, k * 53 % 700 + 0.25, F.col("c_nationkey") + 10.5, k % 13 + 8.5)


def _zones(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _box(table(spark, d, "supplier", "s_suppkey", "s_nationkey"), "s_suppkey", k * 97 % 1000, k * 71 % 700, F.col("s_nationkey") + 60, F.lit(50))


@query("join_polygon_overlap", f"""WITH a AS ({_A}), b AS ({_B}), p AS (SELECT a.id, b.id match_id, (least(a.x0+a.w,b.x0+b.w)-greatest(a.x0,b.x0))*(least(a.y0+a.h,b.y0+b.h)-greatest(a.y0,b.y0)) s, a.w*a.h t FROM a JOIN b ON a.x0<b.x0+b.w AND b.x0<a.x0+a.w AND a.y0<b.y0+b.h AND b.y0<a.y0+a.h),
 k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, match_id) k FROM p) SELECT a.id, match_id, round(s/t,6) overlap_frac FROM a LEFT JOIN k ON a.id=k.id AND k.k=1""")
def join_polygon_overlap(spark, d):
    return P.largest_overlap(_parcels(spark, d), _zones(spark, d), 64.0).select("id", "match_id", r("overlap_frac").alias("overlap_frac"))


@query("pure_fraction", f"SELECT id, CAST(v AS DOUBLE) width, round(greatest(0,w-v)*greatest(0,h-v)/(w*h),6) pure FROM ({_A}), (SELECT unnest([1.2,5,10,20]) v)")
def pure_fraction(spark, d):
    return P.pure_fraction(_parcels(spark, d), [1.2, 5.0, 10.0, 20.0]).select("id", "width", r("pure").alias("pure"))


@query("rasterise_ladder", f"""WITH a AS ({_A}), b AS (SELECT id, v.level, CASE WHEN i>0 THEN ceil((x0+i)/5-0.5) ELSE floor(x0/5) END c0, CASE WHEN i>0 THEN floor((x0+w-i)/5-0.5) ELSE floor((x0+w)/5) END c1, CASE WHEN i>0 THEN ceil((y0+i)/5-0.5) ELSE floor(y0/5) END r0, CASE WHEN i>0 THEN floor((y0+h-i)/5-0.5) ELSE floor((y0+h)/5) END r1 FROM a, (VALUES (0,5.0),(1,2.0),(2,0.0)) v(level,i)),
 q AS (SELECT id, level, unnest(range(r0::BIGINT,r1::BIGINT+1)) y, c0, c1 FROM b), c AS (SELECT id, level, y, unnest(range(c0::BIGINT,c1::BIGINT+1)) x FROM q), w0 AS (SELECT x,y,max(id) id, 0 level FROM c WHERE level=0 GROUP BY x,y), w1 AS (SELECT x,y,max(id) id, 1 level FROM c WHERE level=1 AND id NOT IN (SELECT id FROM w0) GROUP BY x,y), w2 AS (SELECT x,y,max(id) id, 2 level FROM c WHERE level=2 AND id NOT IN (SELECT id FROM w0 UNION ALL SELECT id FROM w1) GROUP BY x,y),
 w AS (FROM w0 UNION ALL FROM w1 UNION ALL FROM w2), l AS (SELECT x,y,arg_min(id,level) id FROM w GROUP BY x,y), g AS (SELECT DISTINCT id, level FROM w) SELECT g.id, g.level, (SELECT count(*) FROM l WHERE l.id=g.id) cells FROM g""")
def rasterise_ladder(spark, d):
    labels, levels = P.rasterise_ladder(_parcels(spark, d), 5.0)
    n = labels.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(n, "id", "left").select("id", "level", F.coalesce("n", F.lit(0)).alias("cells"))


@query("target_grid", f"SELECT id%5 AS zone, floor((min(x0)-30)/10)*10 AS \"left\", ceil((max(y0+h)+30)/10)*10 AS top, CAST((ceil((max(x0+w)+30)/10)-floor((min(x0)-30)/10)) AS INT) AS width, CAST((ceil((max(y0+h)+30)/10)-floor((min(y0)-30)/10)) AS INT) AS height FROM ({_A}) GROUP BY 1")
def target_grid(spark, d):
    b = _parcels(spark, d).groupBy((F.col("id") % 5).alias("zone")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max(F.col("x0") + F.col("w")).alias("x1"), F.max(F.col("y0") + F.col("h")).alias("y1"))
    return b.select("zone", *W.target_grid(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], 30.0, 10.0))


@query("aoi_window", f"SELECT id%5 AS zone, CAST(greatest(0,trunc(min(x0))-64) AS INT) AS start, CAST(least(900,trunc(max(x0+w))+64)-greatest(0,trunc(min(x0))-64) AS INT) AS size FROM ({_A}) GROUP BY 1")
def aoi_window(spark, d):
    b = _parcels(spark, d).groupBy((F.col("id") % 5).alias("zone")).agg(F.min("x0").alias("lo"), F.max(F.col("x0") + F.col("w")).alias("hi"))
    start, size = W.aoi_window(F.col("lo"), F.col("hi"), 64, F.lit(900))
    return b.select("zone", start.alias("start"), size.alias("size"))


# --- control points


@query("geocode", "SELECT l_returnflag AS scene, CAST(floor((500.1+2*l_linenumber+0.5*(l_orderkey%1000))/7) AS BIGINT) AS gx, CAST(floor((900.1-3*(l_orderkey%1000)+0.25*l_linenumber)/7) AS BIGINT) AS gy, round(avg(CAST(round(l_extendedprice*100) AS BIGINT)),3) AS value, count(*) AS looks FROM lineitem GROUP BY 1,2,3")
def geocode(spark, d):
    pixels = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("scene"), (F.col("l_orderkey") % 1000).alias("row"), F.col("l_linenumber").alias("col"), F.round(F.col("l_extendedprice") * 100).alias("value"))
    at = spark.range(25).select((F.col("id") % 5 * 250).alias("row"), F.floor(F.col("id") / 5).alias("c")).select("row", (F.col("c") * 2).alias("col"))
    points = pixels.select("scene").distinct().crossJoin(at).select("scene", "row", "col", (500.1 + 2 * F.col("col") + 0.5 * F.col("row")).alias("x"), (900.1 - 3 * F.col("row") + 0.25 * F.col("col")).alias("y"))
    return W.geocode(pixels, points, 7.0).select("scene", "gx", "gy", r("value", 3).alias("value"), "looks")


_EARTH = """WITH p AS (SELECT p_partkey, radians(72+p_size/100.0) lo, radians(22+(p_partkey%17)/100.0) la, p_size::DOUBLE h, p_partkey%10+0.5 t, (1/298.257223563)*(2-1/298.257223563) e FROM part), n AS (SELECT *, 6378137.0/sqrt(1-e*sin(la)*sin(la)) n FROM p),
 g AS (SELECT p_partkey, e, (n+h)*cos(la)*cos(lo) x, (n+h)*cos(la)*sin(lo) y, (n*(1-e)+h)*sin(la) z, 1500000+1000*t sx, 6500000.0 sy, 2500000+7000*t sz FROM n), l AS (SELECT p_partkey, sx-x lx, sy-y ly, sz-z lz, x, y, z/(1-e) u FROM g)"""


@query("incidence", _EARTH + " SELECT p_partkey, round(degrees(acos((lx*x+ly*y+lz*u)/sqrt(lx*lx+ly*ly+lz*lz)/sqrt(x*x+y*y+u*u))),5) incidence FROM l")
def incidence(spark, d):
    states = F.array(*[F.struct(F.lit(float(k)).alias("t"), F.array(F.lit(1.5e6 + 1000 * k), F.lit(6.5e6), F.lit(2.5e6 + 7000 * k)).alias("p")) for k in range(12)])
    p = table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in zip("xyz", W.ecef(72 + F.col("p_size") / 100, 22 + F.col("p_partkey") % 17 / 100, F.col("p_size")))], (F.col("p_partkey") % 10 + 0.5).alias("t"))
    return p.select("p_partkey", r(W.incidence([F.col(c) for c in "xyz"], W.orbit_at(F.col("t"), states)), 5).alias("incidence"))


@query("loo_tps")
def loo_tps(spark, d):
    """Leave-one-out error of a thin-plate spline through each group of control points."""
    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates(["x", "y"])
        e = np.abs(W.loo_plate(b[["x", "y"]].to_numpy(float), b["t"].to_numpy(float))) if len(b) > 4 else np.array([np.nan])
        return pd.DataFrame({"label": b["label"].iloc[:1], "n": [len(b)], "median_error": [float(np.median(e))], "p95": [float(np.percentile(e, 95))]})

    e = F.col("embedding")
    g = table(spark, d, "embeddings").select("label", *[e[k].cast("double").alias(n) for k, n in enumerate("xyt")])
    return g.groupBy("label").applyInPandas(run, f"label {dict(g.dtypes)['label']}, n long, median_error double, p95 double")


# --- binary files


@query("src_shapefile", f"SELECT id, id%4 AS file, round(w*h,6) AS area, 'S'||id AS name FROM ({_B})")
def src_shapefile(spark, d):
    """One shapefile and attribute table for each quarter of the suppliers, written and read back."""
    def pack(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id")
        rows = [f" {k:<10}S{k:<9}".encode() for k in b["id"]]
        fields = b"".join(n.ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15 for n in (b"id", b"name"))
        head = bytes([3, 124, 1, 1]) + len(rows).to_bytes(4, "little") + (32 + 64 + 1).to_bytes(2, "little") + (21).to_bytes(2, "little") + b"\0" * 20
        return pd.DataFrame({"path": [f"/z{b['file'].iloc[0]}.{k}" for k in ("shp", "dbf")], "content": [IO.shapefile_bytes(list(b["rings"])), head + fields + b"\r" + b"".join(rows)]})

    files = _zones(spark, d).withColumn("file", F.col("id") % 4).groupBy("file").applyInPandas(pack, "path string, content binary")
    s = IO.read_shapefiles(files)
    ring = s.select("stem", "attributes", F.element_at("rings", 1).alias("q"))
    area = F.abs(F.aggregate(F.sequence(F.lit(1), F.size("q") - 1), F.lit(0.0), lambda t, k: t + F.element_at("q", k)[0] * F.element_at("q", k + 1)[1] - F.element_at("q", k + 1)[0] * F.element_at("q", k)[1])) / 2
    return ring.select(F.col("attributes")["id"].cast("long").alias("id"), F.substring_index("stem", "z", -1).cast("long").alias("file"), r(area).alias("area"), F.col("attributes")["name"].alias("name"))


_CELLS = "SELECT p_brand AS path, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)-1) k, p_retailprice v FROM part"


def _rasters(spark, d) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    c = table(spark, d, "part").select(F.col("p_brand").alias("path"), k.cast("long").alias("k"), F.col("p_retailprice").alias("value"))
    return IO.write_rasters(c.select("path", F.floor(F.col("k") / 16).alias("row"), (F.col("k") % 16).alias("col"), "value"), 5.0)


@query("src_raster", f"SELECT path, k//16 AS \"row\", k%16 AS col, v AS value FROM ({_CELLS})")
def src_raster(spark, d):
    return IO.read_rasters(_rasters(spark, d)).where("value is not null")


@query("snk_geotiff", f"SELECT path, CAST(least(16,max(k)+1) AS INT) width, CAST(max(k)//16+1 AS INT) height, 5.0::DOUBLE dx, 5.0::DOUBLE dy, 0.0::DOUBLE AS \"left\", 5.0*(max(k)//16+1)::DOUBLE top FROM ({_CELLS}) GROUP BY 1")
def snk_geotiff(spark, d):
    return IO.raster_info(_rasters(spark, d))


@query("src_slc_chunked", "WITH c AS (SELECT c_nationkey path, c_custkey%100-50 re, c_custkey%31 im, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)-1 k, count(*) OVER (PARTITION BY c_nationkey) n FROM customer) SELECT path::VARCHAR path, k//4 AS \"row\", CAST(sum(re*re+im*im) AS BIGINT) power FROM c WHERE k<n//4*4 GROUP BY 1,2")
def src_slc_chunked(spark, d):
    """Power of complex rows; a last row that is not whole is no row."""
    def pack(b: pd.DataFrame) -> pd.DataFrame:
        k = b.sort_values("c_custkey")["c_custkey"].to_numpy()
        return pd.DataFrame({"path": [str(b["c_nationkey"].iloc[0])], "content": [np.stack([k % 100 - 50, k % 31], 1).astype("<i2").tobytes()]})

    files = table(spark, d, "customer", "c_custkey", "c_nationkey").groupBy("c_nationkey").applyInPandas(pack, "path string, content binary")
    re, im = F.col("re").cast("long"), F.col("im").cast("long")
    return IO.read_complex(files, 4, 8).groupBy("path", "row").agg(F.sum(re * re + im * im).alias("power"))


@query("src_excel", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def src_excel(spark, d):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": [f"sheet{k}" for k in b.index], "content": [IO.sheet_bytes([["id", "name"], [k, n]]) for k, n in zip(b["n_nationkey"], b["n_name"])]})

    files = table(spark, d, "nation", "n_nationkey", "n_name").mapInPandas(pack, "path string, content binary")
    return IO.read_sheets(files).where("row > 1").select(F.col("cells")["A"].alias("id"), F.col("cells")["B"].alias("name"))


@query("src_stac", "SELECT CAST(o_orderkey AS VARCHAR) id, o_orderdate AS datetime, round(o_totalprice/5000,2) cloud FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2030-12-31' AND round(o_totalprice/5000,2)<60 AND o_custkey%360-180<=100 AND o_custkey%360-175>=20 ORDER BY cloud, id LIMIT 40")
def src_stac(spark, d):
    x, c = F.col("o_custkey") % 360, F.round(F.col("o_totalprice") / 5000, 2)
    items = table(spark, d, "orders").select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.array(x - 180, F.lit(-1), x - 175, F.lit(1)).alias("bbox"), F.struct(F.col("o_orderdate").alias("datetime"), c.alias("cloud")).alias("properties"))).alias("json"))
    return IO.catalogue_search(items, (20.0, -5.0, 100.0, 5.0), "1995-01-01", "2030-12-31", 60.0, 40)


# --- trials of variants

_FEATS = "SELECT vec_id id, label g, embedding[1]::DOUBLE a, CASE WHEN vec_id%7<>0 THEN embedding[2]::DOUBLE END b, -embedding[3]::DOUBLE c, embedding[4]::DOUBLE w1, embedding[5]::DOUBLE w2 FROM embeddings"
_VARIANTS = [("incumbent", 0.25, 0.25, 0.5, True), ("no_c", 0.5, 0.5, 0.0, True), ("bounded", 0.25, 0.25, 0.5, False), ("rebalanced", 0.25, 0.5, 0.25, False), ("b_alone", 0.0, 1.0, 0.0, False)]
_VALUES = ",".join(f"('{n}',{a}::DOUBLE,{b}::DOUBLE,{c}::DOUBLE,{str(k).lower()})" for n, a, b, c, k in _VARIANTS)


def _feats(spark, d) -> DataFrame:
    e = [F.col("embedding")[k].cast("double") for k in range(5)]
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("g"), e[0].alias("a"), F.when(F.col("vec_id") % 7 != 0, e[1]).alias("b"), (-e[2]).alias("c"), e[3].alias("w1"), e[4].alias("w2"))


def _avg_rank_sql(x: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x})+(count(*) OVER (PARTITION BY {by},{x})-1)/2.0)"


@query("variant_bakeoff", f"""WITH t AS ({_FEATS}), v AS (SELECT variant, ranked, id, g, w1, w2, (wa*a+wb*coalesce(b,0)+wc*c)/nullif(wa+CASE WHEN b IS NULL THEN 0 ELSE wb END+wc,0) raw FROM t, (VALUES {_VALUES}) k(variant,wa,wb,wc,ranked)), s AS (SELECT * FROM v WHERE raw IS NOT NULL),
 m AS (SELECT variant, g, median(raw) c, count(*) n FROM s GROUP BY 1,2), q AS (SELECT s.*, m.c, m.n FROM s JOIN m USING(variant,g)), z AS (SELECT variant, g, 1.4826*median(abs(raw-c)) sd FROM q GROUP BY 1,2), y AS (SELECT q.*, (raw-c)/CASE WHEN sd>0 THEN sd ELSE 1 END z FROM q JOIN z USING(variant,g)),
 h AS (SELECT variant, w1, w2, CASE WHEN n<5 THEN 50 WHEN ranked THEN 100*({_avg_rank_sql('raw', 'variant,g')}/n) ELSE 100*({S.normal_cdf_sql('z')}) END h FROM y), k AS (SELECT variant, {_avg_rank_sql('round(h,9)', 'variant')} rh, {_avg_rank_sql('w1', 'variant')} r1, {_avg_rank_sql('w2', 'variant')} r2 FROM h)
 SELECT variant, count(*) n, round(corr(rh,r1),5) rho1, round(corr(rh,r2),5) rho2 FROM k GROUP BY 1""")
def variant_bakeoff(spark, d):
    """Variants of the index (weights, ranks or bounded scores) against two columns that are not in it."""
    k = F.broadcast(spark.createDataFrame(_VARIANTS, "variant string, wa double, wb double, wc double, ranked boolean"))
    w, there = [F.col(f"w{x}") for x in "abc"], F.when(F.col("b").isNull(), 0.0).otherwise(F.col("wb"))
    raw = (w[0] * F.col("a") + w[1] * F.coalesce("b", F.lit(0.0)) + w[2] * F.col("c")) / F.nullif(w[0] + there + w[2], F.lit(0.0))
    v = _feats(spark, d).crossJoin(k).withColumn("raw", raw).where("raw is not null").withColumn("at", F.concat_ws("|", "variant", "g"))
    v = C.health_index(v, "raw", "at", "bounded").withColumn("n", F.count(F.lit(1)).over(A._within(["at"])))
    h = F.when(F.col("n") < 5, 50.0).when(F.col("ranked"), 100 * A.rank_pct("raw", ["at"])).otherwise(F.col("bounded"))
    v = v.withColumn("h", F.round(h, 9))
    one, two = (A.spearman(v, "h", x, ["variant"]).select("variant", "n", r("rho", 5).alias(f"rho{x[1]}")) for x in ("w1", "w2"))
    return one.join(two.drop("n"), "variant")


@query("jitter_weights", f"""WITH t AS ({_FEATS}), u AS (SELECT rep, name, ('0x'||left(md5(rep||'|'||name),8))::BIGINT/4294967296.0+0.5 f FROM (SELECT unnest(range(1,21)) rep), (SELECT unnest(['a','b','c']) name)), w AS (SELECT rep, max(f) FILTER (name='a') fa, max(f) FILTER (name='b') fb, max(f) FILTER (name='c') fc FROM u GROUP BY 1),
 s AS (SELECT rep, a*0.5+coalesce(b,0)*0.3+c*0.2 base, a*0.5*fa+coalesce(b,0)*0.3*fb+c*0.2*fc moved FROM t, w), k AS (SELECT rep, {_avg_rank_sql('base', 'rep')} x, {_avg_rank_sql('moved', 'rep')} y FROM s) SELECT rep::INT rep, round(corr(x,y),5) rho FROM k GROUP BY 1""")
def jitter_weights(spark, d):
    """Rank correlation of the index with itself under weights times a draw from 0.5 to 1.5."""
    reps = spark.range(1, 21).select(F.col("id").cast("int").alias("rep"))
    u = {n: F.conv(F.substring(F.md5(F.concat_ws("|", "rep", F.lit(n)).cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0 + 0.5 for n in "abc"}
    w = F.broadcast(reps.select("rep", *[c.alias(f"f{n}") for n, c in u.items()]))
    b = F.coalesce("b", F.lit(0.0))
    s = _feats(spark, d).crossJoin(w).withColumn("base", F.col("a") * 0.5 + b * 0.3 + F.col("c") * 0.2).withColumn("moved", F.col("a") * 0.5 * F.col("fa") + b * 0.3 * F.col("fb") + F.col("c") * 0.2 * F.col("fc"))
    return A.spearman(s, "base", "moved", ["rep"]).select("rep", r("rho", 5).alias("rho"))


@query("anchor_rescale", """WITH t AS (SELECT p_type g, p_retailprice y, p_retailprice*CASE WHEN p_type=(SELECT min(p_type) FROM part) THEN 1.7 ELSE 1 END z, p_size o, p_size area FROM part), k AS (SELECT rank() OVER (ORDER BY y)+(count(*) OVER (PARTITION BY y)-1)/2.0 ry, rank() OVER (ORDER BY z)+(count(*) OVER (PARTITION BY z)-1)/2.0 rz, rank() OVER (ORDER BY o)+(count(*) OVER (PARTITION BY o)-1)/2.0 ro FROM t)
 SELECT round(corr(ry,ro),5) before, round(corr(rz,ro),5) AS after, (SELECT round(100*(sum(z*area)/sum(y*area)-1),4) FROM t) total_pct FROM k""")
def anchor_rescale(spark, d):
    """Another source's rank correlation, and the total, before and after one class's anchor is corrected."""
    p = table(spark, d, "part").select("p_type", F.col("p_retailprice").alias("y"), F.col("p_size").alias("o"))
    t = p.crossJoin(F.broadcast(p.agg(F.min("p_type").alias("m")))).withColumn("z", F.col("y") * F.when(F.col("p_type") == F.col("m"), 1.7).otherwise(1.0))
    total = t.agg(r(100 * (F.sum(F.col("z") * F.col("o")) / F.sum(F.col("y") * F.col("o")) - 1), 4).alias("total_pct"))
    before, after = (A.spearman(t, x, "o").select(r("rho", 5).alias(n)) for x, n in (("y", "before"), ("z", "after")))
    return before.crossJoin(F.broadcast(after)).crossJoin(F.broadcast(total))


@query("classify_independent")
def classify_independent(spark, d):
    """A second opinion from other evidence by the same assignment, and its agreement with the first label."""
    f = _feats(spark, d).withColumn("village", F.lit(1))
    e = C.evidence(f, [("Rice", "a", -1.0), ("Rice", "b", -0.4), ("Cotton", "b", 0.8), ("Cotton", "c", 0.9), ("Maize", "w1", 0.8), ("Maize", "c", -0.6)], "id")
    q = C.fit_prior(e.select(F.lit(1).alias("village"), "id", S.softmax(F.col("e")).alias("p"), F.lit(1.0).alias("area")), "village", "id", [0.3, 0.4, 0.3])
    names = ["Rice", "Cotton", "Maize"]
    mine = q.select("id", S.argmax_label(F.col("q"), names).alias("crop"))
    first = f.select("id", F.element_at(F.array(*map(F.lit, names)), (F.col("g") % 3 + 1).cast("int")).alias("label"))
    return A.kappa(mine.join(first, "id"), "crop", "label")


@query("regress_cv")
def regress_cv(spark, d):
    """Out-of-fold R squared of a forest regression on spatial folds; MLlib, so values are not those of another library."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    f = _feats(spark, d).na.fill(0.0, ["b"])
    f = VectorAssembler(inputCols=["a", "b"], outputCol="xy").transform(f)
    f = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(f)
    f = KMeans(k=3, seed=1, featuresCol="xy", predictionCol="fold").fit(f).transform(f)
    out = None
    for k in range(3):
        m = RandomForestRegressor(numTrees=20, maxDepth=5, minInstancesPerNode=5, seed=1, labelCol="w1").fit(f.where(F.col("fold") != k))
        p = m.transform(f.where(F.col("fold") == k)).select("w1", "prediction")
        out = p if out is None else out.unionByName(p)
    rss, n = F.sum((F.col("w1") - F.col("prediction")) ** 2), F.count(F.lit(1))
    return out.agg(n.alias("n"), (1 - rss / (F.var_pop("w1") * n)).alias("r2"))
