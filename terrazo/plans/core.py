"""Queries: scans, projections, joins, aggregations, windows, sampling, set operations, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrazo.functions import scalars as S
from terrazo.operators import analytics as A
from terrazo.operators import gates as G
from terrazo.operators import halves as H
from terrazo.operators import relational as R
from terrazo.sources import files as IO

from .registry import query, r, table

CROPS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_ZONE = "SELECT l_partkey, count(*) n, sum(CAST(round(l_extendedprice*100) AS BIGINT))::DOUBLE/count(*)/100 mean, stddev_pop(l_extendedprice) sd, median(l_extendedprice) med FROM lineitem GROUP BY 1"


def _cents(column: str):
    """Money as whole cents: sums are exact in any order, so reruns and other engines agree to the last bit."""
    return F.round(F.col(column) * 100).cast("long")


def zones(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each zone's pixels."""
    g = table(spark, d, "lineitem", "l_partkey", "l_extendedprice").groupBy("l_partkey")
    return g.agg(F.count("l_extendedprice").alias("n"), (F.sum(_cents("l_extendedprice")).cast("double") / F.count("l_extendedprice") / 100).alias("mean"), F.stddev_pop("l_extendedprice").alias("sd"), F.median("l_extendedprice").alias("med"))


@query("zonal_stats", f"SELECT l_partkey, n, mean, CASE WHEN n>1 THEN round(sd,6) END sd, round(med,6) med, CASE WHEN mean>0 THEN round(sd/mean,6) END cv FROM ({_ZONE})")
def zonal_stats(spark, d):
    z = zones(spark, d)
    return z.select("l_partkey", "n", "mean", F.when(F.col("n") > 1, r("sd")).alias("sd"), r("med").alias("med"), F.when(F.col("mean") > 0, r(F.col("sd") / F.col("mean"))).alias("cv"))


@query("entity_report", f"""WITH z AS ({_ZONE}), j AS (SELECT p_partkey, p_type, n, mean, sd/nullif(mean,0) cv FROM part LEFT JOIN z ON p_partkey=l_partkey),
 c AS (SELECT p_type, median(mean) c, count(mean) k FROM j GROUP BY 1), s AS (SELECT j.p_type, 1.4826*median(abs(mean-c)) s FROM j JOIN c USING(p_type) GROUP BY 1)
 SELECT p_partkey, p_type, coalesce(n,0) n, mean, round(cv,6) cv, CASE WHEN coalesce(n,0)>=4 THEN 'ok' WHEN coalesce(n,0)=0 THEN 'no_sar_data' ELSE 'partial' END qc_flag,
 round(CASE WHEN mean IS NULL OR k<10 OR s<=0 THEN 0 ELSE least(greatest((mean-c)/s,-4),4) END,6) z FROM j JOIN c USING(p_type) JOIN s USING(p_type)""")
def entity_report(spark, d):
    """Pixels to zones, joined to their attributes, flagged and scored within their class."""
    z = zones(spark, d)
    j = table(spark, d, "part", "p_partkey", "p_type").join(z, F.col("p_partkey") == F.col("l_partkey"), "left")
    j = j.withColumn("cv", F.try_divide("sd", "mean")).withColumn("n", F.coalesce("n", F.lit(0)))
    out = A.robust_z(j, "mean", "z", ["p_type"])
    return out.select("p_partkey", "p_type", "n", "mean", r("cv").alias("cv"), S.qc_flag(F.col("n")).alias("qc_flag"), r("z").alias("z"))


# --- sources and sinks


@query("src_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_csv(spark, d):
    from terrazo.session import scratch_path

    path = scratch_path(spark, "csv")
    IO.write_csv(table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), path)
    return IO.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("src_raster_window", "SELECT l_orderkey AS row, l_linenumber AS col, l_extendedprice AS value FROM lineitem WHERE l_orderkey BETWEEN 100 AND 400 AND l_linenumber BETWEEN 1 AND 4 AND l_orderkey % 2 = 0 AND l_linenumber % 2 = 0")
def src_raster_window(spark, d):
    from terrazo.session import scratch_path

    path = scratch_path(spark, "tiles")
    t = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    IO.write_tiles(t.select(F.lit("base").alias("grid"), F.lit("20250606").alias("date"), F.floor(F.col("l_orderkey") / 1000).alias("tile"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_extendedprice").alias("value")), path)
    return IO.read_window(spark, path, "base", "20250606", (100, 400), (1, 4), 2).select("row", "col", "value")


@query("src_json_meta", "SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events")
def src_json_meta(spark, d):
    return table(spark, d, "events", "event_id", "props").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("src_file_resolve", "SELECT url AS path FROM pages WHERE contains(split_part(url,'/',-1),'25') AND contains(left(url, length(url)-length(split_part(url,'/',-1))-1),'5')")
def src_file_resolve(spark, d):
    p = table(spark, d, "pages", "url").select(F.col("url").alias("path"))
    base, folder = F.element_at(F.split("path", "/"), -1), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return p.where(F.contains(base, F.lit("25")) & F.contains(folder, F.lit("5")))


@query("src_wfs_paged", """WITH p AS (SELECT user_id id, event_id//100 page FROM events), f AS (SELECT *, min(page) OVER (PARTITION BY id) first FROM p),
 s AS (SELECT min(page) stop FROM (SELECT page, count_if(first=page) new FROM f GROUP BY page) WHERE new=0)
 SELECT DISTINCT id, page FROM f, s WHERE first=page AND (stop IS NULL OR page<stop)""")
def src_wfs_paged(spark, d):
    return IO.paged(table(spark, d, "events").select(F.col("user_id").alias("id"), F.floor(F.col("event_id") / 100).alias("page")), "id", "page")


@query("src_rest_point", "SELECT event_id, ts, value FROM events WHERE value >= 0")
def src_rest_point(spark, d):
    return table(spark, d, "events", "event_id", "ts", "value").where("value >= 0")


@query("src_notebook_mine", """SELECT w AS word, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text,'[A-Z][a-z]{6,}')) w FROM documents) GROUP BY 1""")
def src_notebook_mine(spark, d):
    w = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{6,}"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("doc_id").alias("docs"))


@query("snk_ledger", "SELECT 'zonal' AS stage, '25' AS n UNION ALL SELECT 'assign', '5'")
def snk_ledger(spark, d):
    from terrazo.session import scratch_path

    path = scratch_path(spark, "ledger")
    for stage, t in (("zonal", "nation"), ("assign", "region")):
        IO.append_ledger(spark, path, stage, {"n": str(table(spark, d, t).count())})
    return IO.read_ledger(spark, path).select("stage", F.col("fields")["n"].alias("n"))


@query("src_schema_pick", "SELECT count(*) AS n FROM region")
def src_schema_pick(spark, d):
    p = IO.pick_schema(spark, [f"{d}/missing.parquet", f"{d}/nation.parquet", f"{d}/region.parquet"], {"r_regionkey", "r_name"})
    return spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n"))


# --- projections


@query("to_db", "SELECT c_custkey, CASE WHEN c_acctbal>0 THEN round(10*log10(c_acctbal),6) END AS db FROM customer")
def to_db(spark, d):
    return table(spark, d, "customer", "c_custkey", "c_acctbal").select("c_custkey", r(S.to_db(F.col("c_acctbal"))).alias("db"))


@query("calibrate_gamma0", """SELECT l_orderkey, l_linenumber, round(1e-6*(l_quantity*l_quantity+l_extendedprice*l_extendedprice),6) AS beta,
 round(1e-6*(l_quantity*l_quantity+l_extendedprice*l_extendedprice)*sin(radians(30+l_discount*100))/cos(radians(30+l_discount*100)),6) AS gamma FROM lineitem""")
def calibrate_gamma0(spark, d):
    b = S.beta0(F.col("l_quantity"), F.col("l_extendedprice"), 1e-6)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(b).alias("beta"), r(S.gamma0(b, 30 + F.col("l_discount") * 100)).alias("gamma"))


@query("recalibrate", "SELECT c_custkey, round(c_acctbal*(1+n_nationkey/10.0),6) AS power, CASE WHEN c_acctbal>0 THEN round(10*log10(c_acctbal)+10*log10(1+n_nationkey/10.0),6) END AS db FROM customer JOIN nation ON c_nationkey=n_nationkey")
def recalibrate(spark, d):
    sf = table(spark, d, "nation", "n_nationkey").select("n_nationkey", (1 + F.col("n_nationkey") / 10.0).alias("sf"))
    j = table(spark, d, "customer").join(F.broadcast(sf), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("c_custkey", r(F.col("c_acctbal") * F.col("sf")).alias("power"), r(S.to_db(F.col("c_acctbal")) + 10 * F.log10("sf")).alias("db"))


_DATES = "SELECT l_partkey id, sum(CASE WHEN month(l_shipdate)%4=0 THEN CAST(round(l_extendedprice*100) AS BIGINT) END)::DOUBLE/count(CASE WHEN month(l_shipdate)%4=0 THEN 1 END)/100 a, sum(CASE WHEN month(l_shipdate)%4=1 THEN CAST(round(l_extendedprice*100) AS BIGINT) END)::DOUBLE/count(CASE WHEN month(l_shipdate)%4=1 THEN 1 END)/100 b, sum(CASE WHEN month(l_shipdate)%4=2 THEN CAST(round(l_extendedprice*100) AS BIGINT) END)::DOUBLE/count(CASE WHEN month(l_shipdate)%4=2 THEN 1 END)/100 c, sum(CASE WHEN month(l_shipdate)%4=3 THEN CAST(round(l_extendedprice*100) AS BIGINT) END)::DOUBLE/count(CASE WHEN month(l_shipdate)%4=3 THEN 1 END)/100 e FROM lineitem GROUP BY 1"


def dates(spark, d):
    m = F.month("l_shipdate") % 4
    g = table(spark, d, "lineitem", "l_partkey", "l_shipdate", "l_extendedprice").groupBy(F.col("l_partkey").alias("id"))
    return g.agg(*[(F.try_divide(F.sum(F.when(m == i, _cents("l_extendedprice"))).cast("double"), F.count_if(m == i).cast("double")) / 100).alias(n) for i, n in enumerate("abce")])


@query("temporal_deltas", f"""SELECT id, c-b aug_jun19, e-c oct_aug, e-a oct_jun06, (CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (coalesce(a,0)+coalesce(b,0))/((a IS NOT NULL)::INT+(b IS NOT NULL)::INT) END) jun FROM ({_DATES})""")
def temporal_deltas(spark, d):
    c = F.col
    return dates(spark, d).select("id", (c("c") - c("b")).alias("aug_jun19"), (c("e") - c("c")).alias("oct_aug"), (c("e") - c("a")).alias("oct_jun06"), S.nan_mean(c("a"), c("b")).alias("jun"))


@query("temporal_stats", f"SELECT id, round(stddev_pop(v)/avg(v),6) cv, max(v)-min(v) range, count(v) n_dates FROM (SELECT id, unnest([a,b,c,e]) v FROM ({_DATES})) GROUP BY id")
def temporal_stats(spark, d):
    v = dates(spark, d).select("id", F.explode(F.array("a", "b", "c", "e")).alias("v"))
    return v.groupBy("id").agg(r(F.stddev_pop("v") / F.avg("v")).alias("cv"), (F.max("v") - F.min("v")).alias("range"), F.count("v").alias("n_dates"))


@query("season_integral", f"SELECT id, 13*(a+b)/2+56*(b+c)/2+60*(c+e)/2 integral FROM ({_DATES})")
def season_integral(spark, d):
    doy = [157, 170, 226, 286]
    pts = dates(spark, d).select("id", F.posexplode(F.array("a", "b", "c", "e")).alias("i", "v")).withColumn("t", F.element_at(F.array(*[F.lit(x) for x in doy]), F.col("i") + 1))
    w = Window.partitionBy("id").orderBy("i")
    step = (F.lead("t").over(w) - F.col("t")) * (F.col("v") + F.lead("v").over(w)) / 2
    return pts.withColumn("s", step).groupBy("id").agg(F.when(F.count("v") == len(doy), F.sum("s")).alias("integral"))


@query("season_integral_strict", """WITH p AS (SELECT user_id id, CAST(ts AS DATE) dt, avg(value) v FROM events GROUP BY 1,2), q AS (SELECT *, date_diff('day', dt, lead(dt) OVER w)*(v+lead(v) OVER w)/2 s FROM p WINDOW w AS (PARTITION BY id ORDER BY dt))
 SELECT id, count(*) n, CASE WHEN count(*)>=6 THEN round(sum(s),3) END integral, CASE WHEN count(*)>=6 THEN round(avg(CASE WHEN v>0 THEN 10*log10(v) END),6) END mean_db FROM q GROUP BY id""")
def season_integral_strict(spark, d):
    p = table(spark, d, "events").groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("dt")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("id").orderBy("dt")
    q = p.withColumn("s", F.datediff(F.lead("dt").over(w), "dt") * (F.col("v") + F.lead("v").over(w)) / 2)
    ok = F.count(F.lit(1)) >= 6
    return q.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.when(ok, r(F.sum("s"), 3)).alias("integral"), F.when(ok, r(F.avg(S.to_db(F.col("v"))))).alias("mean_db"))


@query("clip_scale_rfi", "SELECT p_partkey, round(coalesce(least(greatest((p_size-3)/12.0,0),1),0),6) flood, p_size>=15 rfi FROM part")
def clip_scale_rfi(spark, d):
    return table(spark, d, "part").select("p_partkey", r(S.clip_scale(F.col("p_size").cast("double"))).alias("flood"), (F.col("p_size") >= 15).alias("rfi"))


@query("qc_provenance", "SELECT p_partkey, CASE WHEN p_size%5>=4 THEN 'ok' WHEN p_size%5=0 THEN 'no_sar_data' ELSE 'partial' END qc_flag, CASE WHEN p_size>=40 THEN 'rfi_flagged' WHEN p_size%5=0 THEN 'imputed_spatial_same_crop' ELSE 'measured' END source FROM part")
def qc_provenance(spark, d):
    n = F.col("p_size") % 5
    return table(spark, d, "part").select("p_partkey", S.qc_flag(n).alias("qc_flag"), S.provenance(F.col("p_size") >= 40, n == 0).alias("source"))


@query("ndvi_cloud_mask", "SELECT l_orderkey, l_linenumber, round((l_quantity-l_tax*100)/nullif(l_quantity+l_tax*100,0),6) ndvi FROM lineitem WHERE round(l_discount*100) IN (4,5,6,7,11)")
def ndvi_cloud_mask(spark, d):
    t = table(spark, d, "lineitem").where(F.round(F.col("l_discount") * 100).isin(4, 5, 6, 7, 11))
    return t.select("l_orderkey", "l_linenumber", r(S.normalised_difference(F.col("l_quantity"), F.col("l_tax") * 100)).alias("ndvi"))


@query("degenerate_filter", "SELECT c_custkey FROM customer, (SELECT median(c_acctbal) m FROM customer) WHERE abs(c_acctbal-m)<=3000 AND c_acctbal>1e-4")
def degenerate_filter(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_acctbal")
    return c.crossJoin(F.broadcast(c.agg(F.median("c_acctbal").alias("m")))).where("abs(c_acctbal - m) <= 3000 AND c_acctbal > 1e-4").select("c_custkey")


@query("alias_normalise", "SELECT p_partkey, CASE WHEN trim(p_name)='' THEN NULL WHEN contains(lower(p_name),'red') THEN 'Rice' WHEN contains(lower(p_name),'blue') THEN 'Cotton' WHEN contains(lower(p_name),'e') THEN 'Maize' ELSE 'Other' END crop FROM part")
def alias_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", S.alias_normalise(F.col("p_name"), [("red", "Rice"), ("blue", "Cotton"), ("e", "Maize")]).alias("crop"))


@query("softmax_entropy", """WITH e AS (SELECT vec_id, embedding[1:5] x FROM embeddings), s AS (SELECT vec_id, list_transform(x, lambda v: exp(v::DOUBLE-list_max(x)::DOUBLE)) k FROM e), p AS (SELECT vec_id, list_transform(k, lambda v: v/list_sum(k)) p FROM s),
 t AS (SELECT vec_id, p, list_transform(p, lambda v: pow(v,0.5)) q FROM p)
 SELECT vec_id, round(p[1],5) p1, round(q[1]/list_sum(q),5) t1, round(-list_sum(list_transform(p, lambda v: v*ln(v)))/ln(5),5) h, ['Rice','Cotton','Maize','Bajra','Groundnut'][list_position(p,list_max(p))] crop FROM t""")
def softmax_entropy(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", S.softmax(F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double"))).alias("p"))
    return e.select("vec_id", r(F.col("p")[0], 5).alias("p1"), r(S.temperature(F.col("p"), 2.0)[0], 5).alias("t1"), r(S.entropy_norm(F.col("p"), 5), 5).alias("h"), S.argmax_label(F.col("p"), ["Rice", "Cotton", "Maize", "Bajra", "Groundnut"]).alias("crop"))


@query("grid_cell", "SELECT concat_ws('_', CAST(floor(embedding[1]/0.5) AS BIGINT), CAST(floor(embedding[2]/0.5) AS BIGINT)) cell, count(*) n FROM embeddings GROUP BY 1")
def grid_cell(spark, d):
    return table(spark, d, "embeddings").select(F.concat_ws("_", F.floor(F.col("embedding")[0] / 0.5), F.floor(F.col("embedding")[1] / 0.5)).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query("wcm_forward", "SELECT p_partkey, round(0.02*p_size/10.0*cos(radians(35))*(1-exp(-2*0.3*p_size/10.0/cos(radians(35))))+0.1*exp(-2*0.3*p_size/10.0/cos(radians(35))),6) power FROM part")
def wcm_forward(spark, d):
    return table(spark, d, "part").select("p_partkey", r(S.wcm_forward(F.col("p_size") / 10.0, 0.02, 0.3, F.lit(0.1), 35.0), 6).alias("power"))


@query("kdist_enl", f"SELECT l_partkey, CASE WHEN n>=12 THEN round(greatest(0,(1+cv*cv)/(1+1.0/20)-1),5) END ktex, round(sqrt(greatest(cv*cv-1.0/20,0)),5) enl FROM (SELECT l_partkey, n, sd/mean cv FROM ({_ZONE}))")
def kdist_enl(spark, d):
    z = zones(spark, d).withColumn("cv", F.col("sd") / F.col("mean"))
    return z.select("l_partkey", r(S.kdist_texture(F.col("cv"), F.col("n"), 20.0), 5).alias("ktex"), r(S.enl_cv(F.col("cv"), 20.0), 5).alias("enl"))


# --- joins


@query("join_inner_left", "SELECT o_orderkey, c_mktsegment, s_name FROM orders JOIN customer ON o_custkey=c_custkey LEFT JOIN supplier ON s_suppkey=o_custkey")
def join_inner_left(spark, d):
    o, c, s = (table(spark, d, x) for x in ("orders", "customer", "supplier"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("s_suppkey") == F.col("o_custkey"), "left").select("o_orderkey", "c_mktsegment", "s_name")


@query("join_semi_anti", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer")
def join_semi_anti(spark, d):
    c, o = table(spark, d, "customer", "c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@query("join_suffix_diff", """WITH a AS (SELECT o_orderpriority m, avg(o_totalprice) v FROM orders WHERE o_orderkey%2=0 GROUP BY 1), b AS (SELECT o_orderpriority m, avg(o_totalprice) v FROM orders GROUP BY 1)
 SELECT m AS metric, round(a.v,6) AS before, round(b.v,6) AS after, round(b.v-a.v,6) AS delta, coalesce(abs(b.v-a.v)>1e-9,true) AS moved FROM a FULL JOIN b USING(m)""")
def join_suffix_diff(spark, d):
    o = table(spark, d, "orders")
    f = lambda x: x.groupBy(F.col("o_orderpriority").alias("metric")).agg(F.avg("o_totalprice").alias("v"))
    x = R.diff(f(o.where("o_orderkey % 2 = 0")), f(o), "metric", "v")
    return x.select("metric", r("before").alias("before"), r("after").alias("after"), r("delta").alias("delta"), "moved")


@query("join_pixel_zone", "SELECT r_name, count(*) n, round(sum(o_totalprice),2) total FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1")
def join_pixel_zone(spark, d):
    o, c, n, g = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


_OVER = "WITH l AS (SELECT o_orderkey id, o_orderkey*1.0 lo, o_orderkey+3.0+o_custkey%7 hi FROM orders), q AS (SELECT p_partkey id, p_partkey*4.0 lo, p_partkey*4.0+p_size hi FROM part)"


def _intervals(spark, d):
    o, p = table(spark, d, "orders"), table(spark, d, "part")
    left = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("double").alias("lo"), (F.col("o_orderkey") + 3.0 + F.col("o_custkey") % 7).alias("hi"))
    right = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 4.0).alias("lo"), (F.col("p_partkey") * 4.0 + F.col("p_size")).alias("hi"))
    return R.largest_overlap(left, right, 64.0)


@query("join_largest_overlap", _OVER + " SELECT l.id, m.rid AS match_id, round(m.o/(l.hi-l.lo),6) AS overlap_frac FROM l LEFT JOIN (SELECT l.id, q.id rid, least(l.hi,q.hi)-greatest(l.lo,q.lo) o, row_number() OVER (PARTITION BY l.id ORDER BY least(l.hi,q.hi)-greatest(l.lo,q.lo) DESC, q.id) k FROM l JOIN q ON l.lo<q.hi AND q.lo<l.hi) m ON m.id=l.id AND m.k=1")
def join_largest_overlap(spark, d):
    return _intervals(spark, d).select("id", "match_id", r("overlap_frac").alias("overlap_frac"))


@query("join_overlap_gate", _OVER + ", x AS (SELECT l.id, max(least(l.hi,q.hi)-greatest(l.lo,q.lo))/any_value(l.hi-l.lo) f FROM l JOIN q ON l.lo<q.hi AND q.lo<l.hi GROUP BY 1) SELECT count(*) n FROM x WHERE f>=0.5 HAVING count(*)>=30")
def join_overlap_gate(spark, d):
    g = R.overlap_gate(_intervals(spark, d), 0.5, 30)
    return g.agg(F.count(F.lit(1)).alias("n")).where("n >= 30")


@query("asof_lookup", """WITH c AS (SELECT p_retailprice k, min(p_size) v FROM part GROUP BY 1), t AS (SELECT arg_max(v,k) v FROM c)
 SELECT s_suppkey, coalesce(c.v, t.v) AS v FROM supplier ASOF LEFT JOIN c ON s_acctbal<=c.k, t""")
def asof_lookup(spark, d):
    curve = table(spark, d, "part").groupBy(F.col("p_retailprice").alias("k")).agg(F.min("p_size").alias("v"))
    return R.asof_forward(table(spark, d, "supplier", "s_suppkey", "s_acctbal"), curve, "s_acctbal", "k", "v", 10.0).select("s_suppkey", "v")


@query("interp_join", """WITH e AS (SELECT user_id, epoch(ts) t, avg(value) v FROM events GROUP BY 1,2), b AS (SELECT *, lead(t) OVER w t2, lead(v) OVER w v2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t))
 SELECT user_id, round(v+(v2-v)*(1704672000-t)/(t2-t),6) v FROM b WHERE t<=1704672000 AND t2>1704672000""")
def interp_join(spark, d):
    e = table(spark, d, "events").groupBy("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy("t")
    b = e.withColumn("t2", F.lead("t").over(w)).withColumn("v2", F.lead("v").over(w)).where("t <= 1704672000 AND t2 > 1704672000")
    return b.select("user_id", r(F.col("v") + (F.col("v2") - F.col("v")) * (1704672000 - F.col("t")) / (F.col("t2") - F.col("t"))).alias("v"))


@query("code_map", "SELECT vec_id, CASE label WHEN 0 THEN 'Rice' WHEN 1 THEN 'Cotton' WHEN 2 THEN 'Maize' END crop FROM embeddings")
def code_map(spark, d):
    m = F.create_map(*[F.lit(x) for p in ((0, "Rice"), (1, "Cotton"), (2, "Maize")) for x in p])
    return table(spark, d, "embeddings").select("vec_id", F.try_element_at(m, F.col("label").cast("int")).alias("crop"))


@query("nearest_of_two", "SELECT c_custkey, CASE WHEN c_acctbal>9000 THEN 'unit' WHEN abs(c_acctbal-1000)<abs(c_acctbal-5000) THEN 'first' ELSE 'second' END cls FROM customer")
def nearest_of_two(spark, d):
    return table(spark, d, "customer").select("c_custkey", R.nearest_of_two(F.col("c_acctbal"), F.lit(1000), F.lit(5000), F.col("c_acctbal") > 9000).alias("cls"))


# --- aggregations


@query("looks_estimate", f"SELECT CASE WHEN count(*)>=20 THEN round(1/pow(quantile_cont(cv,0.05),2),3) END looks FROM (SELECT sd/mean cv FROM ({_ZONE}) WHERE n>=10)")
def looks_estimate(spark, d):
    z = zones(spark, d).where("n >= 10").select((F.col("sd") / F.col("mean")).alias("cv"))
    return z.agg(F.when(F.count(F.lit(1)) >= 20, r(1 / F.pow(F.percentile("cv", 0.05), F.lit(2)), 3)).alias("looks"))


@query("zonal_fraction", "SELECT l_partkey, round(avg((l_returnflag='R')::INT),6) share FROM lineitem GROUP BY 1")
def zonal_fraction(spark, d):
    return table(spark, d, "lineitem", "l_partkey", "l_returnflag").groupBy("l_partkey").agg(r(F.avg((F.col("l_returnflag") == "R").cast("int"))).alias("share"))


@query("groupby_basic", "SELECT c_mktsegment, count(*) n, round(sum(c_acctbal),2) s, round(median(c_acctbal),6) med, round(avg(c_acctbal),6) m, round(stddev_samp(c_acctbal),6) sd, min(c_acctbal) lo, max(c_acctbal) hi, round(quantile_cont(c_acctbal,0.25),6) p25, round(quantile_cont(c_acctbal,0.75),6) p75 FROM customer GROUP BY 1")
def groupby_basic(spark, d):
    v = "c_acctbal"
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), r(F.sum(v), 2).alias("s"), r(F.median(v)).alias("med"), r(F.avg(v)).alias("m"), r(F.stddev_samp(v)).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"), r(F.percentile(v, 0.25)).alias("p25"), r(F.percentile(v, 0.75)).alias("p75"))


@query("area_share", "SELECT o_orderpriority, round(sum(o_totalprice)/sum(sum(o_totalprice)) OVER (),5) share FROM orders GROUP BY 1")
def area_share(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("a"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("a").alias("t")))).select("o_orderpriority", r(F.col("a") / F.col("t"), 5).alias("share"))


@query("production", "SELECT coalesce(p_type,'VILLAGE') crop, round(sum(p_size*p_retailprice),2) production, sum(p_size) area FROM part GROUP BY ROLLUP(p_type)")
def production(spark, d):
    return table(spark, d, "part").rollup("p_type").agg(r(F.sum(F.col("p_size") * F.col("p_retailprice")), 2).alias("production"), F.sum("p_size").alias("area")).select(F.coalesce("p_type", F.lit("VILLAGE")).alias("crop"), "production", "area")


@query("ratio_of_sums", "SELECT f AS flag, round(median(q),5) med, round(avg(q),5) mean, round(quantile_cont(q,0.25),5) p25, round(quantile_cont(q,0.75),5) p75 FROM (SELECT l_returnflag f, year(l_shipdate)*100+month(l_shipdate) y, sum(l_extendedprice)/nullif(sum(l_quantity),0) q FROM lineitem GROUP BY 1,2) GROUP BY 1")
def ratio_of_sums(spark, d):
    y = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.date_trunc("month", "l_shipdate").alias("y")).agg(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("q"))
    return y.groupBy("flag").agg(r(F.median("q"), 5).alias("med"), r(F.avg("q"), 5).alias("mean"), r(F.percentile("q", 0.25), 5).alias("p25"), r(F.percentile("q", 0.75), 5).alias("p75"))


@query("weighted_mean", "SELECT p_brand, round(sum(p_retailprice*p_size)/sum(p_size),6) w FROM part GROUP BY 1")
def weighted_mean(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(r(F.sum(F.col("p_retailprice") * F.col("p_size")) / F.sum("p_size")).alias("w"))


@query("crosstab", "SELECT o_orderpriority, count_if(o_orderstatus='F') AS f, count_if(o_orderstatus='O') AS o, count_if(o_orderstatus='P') AS p FROM orders GROUP BY 1")
def crosstab(spark, d):
    x = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return x.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("mode_vote", """SELECT id, label, votes FROM (SELECT id, label, count(*) votes, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) k FROM (SELECT p_partkey id, unnest([p_size%3, p_size%2, p_partkey%3, p_partkey%2, CAST(floor(p_retailprice) AS BIGINT)%3, 1]) label FROM part) GROUP BY 1,2) WHERE k=1""")
def mode_vote(spark, d):
    six = F.array(*[x.cast("long") for x in (F.col("p_size") % 3, F.col("p_size") % 2, F.col("p_partkey") % 3, F.col("p_partkey") % 2, F.floor("p_retailprice") % 3, F.lit(1))])
    v = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(six).alias("label")).groupBy("id", "label").agg(F.count(F.lit(1)).alias("votes"))
    return R.first_per_key(v, ["id"], [F.desc("votes"), F.asc("label")])


@query("monthly_agg", "SELECT strftime(o_orderdate,'%Y-%m') AS month, count(*) scenes, count_if(o_totalprice<100000) usable, min(o_totalprice) best FROM (SELECT *, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) k FROM orders) WHERE k=1 GROUP BY 1")
def monthly_agg(spark, d):
    o = R.first_per_key(table(spark, d, "orders"), ["o_orderdate"], ["o_orderkey"])
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("scenes"), F.count_if(F.col("o_totalprice") < 100000).alias("usable"), F.min("o_totalprice").alias("best"))


@query("between_var_share", """WITH s AS (SELECT c_custkey, c_acctbal v, k, CAST(floor(c_custkey/k) AS BIGINT) cell FROM customer, (SELECT unnest([2,4,8,16,32,64,128,256]) k)), m AS (SELECT *, avg(v) OVER (PARTITION BY k, cell) g FROM s) SELECT k, round(var_samp(g)/var_samp(v),5) share, count(DISTINCT cell) cells FROM m GROUP BY k""")
def between_var_share(spark, d):
    s = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v"), F.explode(F.array(*[F.lit(2**i) for i in range(1, 9)])).alias("k")).withColumn("cell", F.floor(F.col("c_custkey") / F.col("k")))
    m = s.withColumn("g", F.avg("v").over(Window.partitionBy("k", "cell")))
    return m.groupBy("k").agg(r(F.var_samp("g") / F.var_samp("v"), 5).alias("share"), F.countDistinct("cell").alias("cells"))


@query("bias_rmse", "SELECT l_returnflag, l_linestatus, round(avg(l_discount-l_tax),5) bias, round(sqrt(avg((l_discount-l_tax)*(l_discount-l_tax))),5) rmse FROM lineitem GROUP BY 1,2")
def bias_rmse(spark, d):
    e = F.col("l_discount") - F.col("l_tax")
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(r(F.avg(e), 5).alias("bias"), r(F.sqrt(F.avg(e * e)), 5).alias("rmse"))


@query("fill_counts", "SELECT count(*) n, count(DISTINCT doc_id) ids, count_if(text IS NULL OR text='') blank, min(n_chars)>=0 ok FROM documents")
def fill_counts(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("blank"), (F.min("n_chars") >= 0).alias("ok"))


# --- windows


@query("robust_z_within", """WITH c AS (SELECT c_mktsegment g, median(c_acctbal) c FROM customer GROUP BY 1), s AS (SELECT g, any_value(c) c, 1.4826*median(abs(c_acctbal-c)) s FROM customer JOIN c ON g=c_mktsegment GROUP BY 1) SELECT c_custkey, round(least(greatest((c_acctbal-c)/s,-3.5),3.5),6) z FROM customer JOIN s ON g=c_mktsegment""")
def robust_z_within(spark, d):
    return A.robust_z(table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment"), "c_acctbal", "z", ["c_mktsegment"], 3.5).select("c_custkey", r("z").alias("z"))


_RANK = "(rank() OVER (PARTITION BY c_mktsegment ORDER BY v)+(count(*) OVER (PARTITION BY c_mktsegment, v)-1)/2.0)"


@query("rank_pct", f"SELECT c_custkey, round({_RANK},2) rk, round({_RANK}/count(*) OVER (PARTITION BY c_mktsegment),5) pct FROM (SELECT c_custkey, c_mktsegment, round(c_acctbal/100) v FROM customer)")
def rank_pct(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.round(F.col("c_acctbal") / 100).alias("v"))
    return t.select("c_custkey", r(A.avg_rank("v", ["c_mktsegment"]), 2).alias("rk"), r(A.rank_pct("v", ["c_mktsegment"]), 5).alias("pct"))


@query("demean_centre", "SELECT c_custkey, round(c_acctbal-avg(c_acctbal) OVER (PARTITION BY c_mktsegment),6) dm, round(c_acctbal-m,6) mc FROM customer, (SELECT median(c_acctbal) m FROM customer)")
def demean_centre(spark, d):
    c = table(spark, d, "customer")
    j = c.crossJoin(F.broadcast(c.agg(F.median("c_acctbal").alias("m"))))
    return j.select("c_custkey", r(F.col("c_acctbal") - F.avg("c_acctbal").over(Window.partitionBy("c_mktsegment"))).alias("dm"), r(F.col("c_acctbal") - F.col("m")).alias("mc"))


@query("qcut_bins", """WITH e AS (SELECT list_distinct(quantile_cont(p_size,[0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1])) e FROM part) SELECT b AS bin, count(*) n, round(avg(p_retailprice),6) m FROM (SELECT p_retailprice, greatest(len(list_filter(e, lambda x: x<p_size))-1,0) b FROM part, e) GROUP BY 1""")
def qcut_bins(spark, d):
    return A.qcut(table(spark, d, "part", "p_size", "p_retailprice"), "p_size", 10, "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r(F.avg("p_retailprice")).alias("m"))


@query("decile_medians", """WITH e AS (SELECT quantile_cont(c_acctbal,[0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]) e FROM customer), b AS (SELECT i, e[i] lo, e[i+1] hi FROM e, (SELECT unnest(range(1,11)) i)) SELECT CAST(i-1 AS INT) AS decile, round(median(c_acctbal),6) x, median(c_custkey) y FROM customer JOIN b ON c_acctbal BETWEEN lo AND hi GROUP BY 1""")
def decile_medians(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_acctbal")
    e = c.agg(F.expr("percentile(c_acctbal, array(0,0.1d,0.2d,0.3d,0.4d,0.5d,0.6d,0.7d,0.8d,0.9d,1))").alias("e"))
    bins = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("c_acctbal") >= F.col("e")[i]) & (F.col("c_acctbal") <= F.col("e")[i + 1]))
    return c.crossJoin(F.broadcast(e)).withColumn("decile", F.explode(bins)).groupBy("decile").agg(r(F.median("c_acctbal")).alias("x"), F.median("c_custkey").alias("y"))


@query("trailing_sum", """WITH p AS (SELECT event_type, CAST(ts AS DATE) dt, sum(value) v FROM events GROUP BY 1,2) SELECT event_type, dt, round(v,6) v, round(sum(v) OVER (PARTITION BY event_type ORDER BY dt RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW),6) s3, round(sum(v) OVER (PARTITION BY event_type ORDER BY dt RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW),6) s7 FROM p""")
def trailing_sum(spark, d):
    p = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("dt")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("event_type").orderBy(F.unix_date("dt"))
    return p.select("event_type", "dt", r("v").alias("v"), r(F.sum("v").over(w.rangeBetween(-3, 0))).alias("s3"), r(F.sum("v").over(w.rangeBetween(-7, 0))).alias("s7"))


@query("trailing_hours", """SELECT a.event_id, round(sum(CASE WHEN b.ts>a.ts-INTERVAL 6 HOUR THEN b.value END),6) h6, round(sum(b.value),6) h24 FROM events a JOIN events b ON a.user_id=b.user_id AND b.ts<=a.ts AND b.ts>a.ts-INTERVAL 24 HOUR GROUP BY 1""")
def trailing_hours(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "value").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us")
    h = 3_600_000_000
    return e.select("event_id", r(F.sum("value").over(w.rangeBetween(-6 * h + 1, 0))).alias("h6"), r(F.sum("value").over(w.rangeBetween(-24 * h + 1, 0))).alias("h24"))


@query("adjacent_delta_share", "SELECT event_id, round(value-lag(value) OVER w,6) delta, round(sum(value) OVER w/sum(value) OVER (PARTITION BY user_id),5) share FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def adjacent_delta_share(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", r(F.col("value") - F.lag("value").over(w)).alias("delta"), r(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("value").over(Window.partitionBy("user_id")), 5).alias("share"))


@query("best_candidate", """WITH s AS (SELECT o_custkey z, o_orderkey scene, o_totalprice cloud, (o_orderkey%100)/100.0 valid FROM orders) SELECT z, scene FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY (valid>0.9) DESC, CASE WHEN valid>0.9 THEN cloud END, valid DESC, scene) k FROM s) WHERE k=1""")
def best_candidate(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("z"), F.col("o_orderkey").alias("scene"), F.col("o_totalprice").alias("cloud"), (F.col("o_orderkey") % 100 / 100.0).alias("valid"))
    good = F.col("valid") > 0.9
    return R.first_per_key(s, ["z"], [good.desc(), F.when(good, F.col("cloud")).asc_nulls_last(), F.desc("valid"), "scene"]).select("z", "scene")


# --- sort, sampling, sets


@query("topk", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25")
def topk(spark, d):
    return R.topk(table(spark, d, "customer", "c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], 25)


_STRAT = "SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('s1|'||c_custkey), c_custkey) k FROM customer WHERE c_acctbal>0"


@query("stratified_sample", f"SELECT c_custkey, c_mktsegment FROM ({_STRAT}) WHERE k<=20")
def stratified_sample(spark, d):
    return A.stratified_sample(table(spark, d, "customer").where("c_acctbal > 0"), "c_mktsegment", "c_custkey", 20, "s1").select("c_custkey", "c_mktsegment")


@query("hybrid_sample", f"WITH a AS (SELECT c_custkey, c_mktsegment FROM ({_STRAT}) WHERE k<=14), b AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY md5('s2|'||c_custkey), c_custkey) k FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY') AND c_custkey NOT IN (SELECT c_custkey FROM a)) SELECT c_custkey, 'stratified' part FROM a UNION ALL SELECT c_custkey, 'weak' FROM b WHERE k<=30")
def hybrid_sample(spark, d):
    c = table(spark, d, "customer")
    a = A.stratified_sample(c.where("c_acctbal > 0"), "c_mktsegment", "c_custkey", 14, "s1").select("c_custkey")
    b = c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(a, "c_custkey", "left_anti")
    b = b.orderBy(A.md5_order("s2", F.col("c_custkey")), "c_custkey").limit(30).select("c_custkey")
    return a.withColumn("part", F.lit("stratified")).unionByName(b.withColumn("part", F.lit("weak")))


@query("split_half", """WITH h AS (SELECT l_partkey g, rep, l_extendedprice v, row_number() OVER (PARTITION BY l_partkey, rep ORDER BY md5(rep||'|'||l_orderkey||'|'||l_linenumber), l_orderkey, l_linenumber, l_extendedprice)%2 half FROM lineitem, (SELECT unnest(range(25)) rep)), m AS (SELECT g, rep, avg(CASE WHEN half=0 THEN v END)-avg(CASE WHEN half=1 THEN v END) d FROM h GROUP BY 1,2) SELECT g, round(stddev_pop(d),3) sd FROM m GROUP BY 1""")
def split_half(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_partkey").alias("g"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_extendedprice").alias("v"))
    return H.half_sd(t, 25).select("g", r("sd", 3).alias("sd"))


@query("set_operations", "SELECT 'union' op, count(*) n FROM (SELECT n_nationkey k FROM nation UNION ALL SELECT c_nationkey FROM customer) UNION ALL SELECT 'except', count(*) FROM (SELECT p_size FROM part EXCEPT SELECT n_nationkey FROM nation) UNION ALL SELECT 'intersect', count(*) FROM (SELECT p_size FROM part INTERSECT SELECT n_nationkey FROM nation)")
def set_operations(spark, d):
    n, c, p = table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "part").select(F.col("p_size").alias("k"))
    cnt = lambda df, op: df.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
    return cnt(n.unionByName(c), "union").unionByName(cnt(p.exceptAll(n.limit(0)).distinct().join(n, "k", "left_anti"), "except")).unionByName(cnt(p.intersect(n), "intersect"))


@query("intersect_agreement", "SELECT CASE WHEN a AND b THEN 'both' WHEN a OR b THEN 'one' ELSE 'neither' END cls, count(*) n FROM (SELECT quality=1 a, toxic=1 b FROM labels) GROUP BY 1")
def intersect_agreement(spark, d):
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, d, "labels").groupBy(F.when(a & b, "both").when(a | b, "one").otherwise("neither").alias("cls")).agg(F.count(F.lit(1)).alias("n"))


# --- gates


@query("gates", "SELECT 'rows_ids' gate, true ok UNION ALL SELECT 'vocab', (SELECT count_if(c_mktsegment NOT IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY')) FROM customer)=0 UNION ALL SELECT 'range', (SELECT bool_and(l_discount BETWEEN 0 AND 1) FROM lineitem) UNION ALL SELECT 'unit', (SELECT bool_and(c_acctbal>=0 AND c_acctbal<25) FROM customer) UNION ALL SELECT 'golden', true UNION ALL SELECT 'columns', true")
def gates(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    out = [G.rows_ids(c, "c_custkey", c.select("c_custkey")), G.vocabulary(c, "c_mktsegment", CROPS), G.in_range(table(spark, d, "lineitem"), "range", "l_discount", 0, 1), G.in_range(c, "unit", "c_acctbal", 0, 25, True), G.golden(n, n), G.columns(n, n.columns)]
    df = out[0].select("gate", "ok")
    for g in out[1:]:
        df = df.unionByName(g.select("gate", "ok"))
    return df


@query("gate_never_over", "SELECT p_type, round(median(p_retailprice),6) med, median(p_retailprice)<=(SELECT quantile_cont(p_retailprice,0.5) FROM part) ok FROM part GROUP BY 1")
def gate_never_over(spark, d):
    p = table(spark, d, "part")
    m = p.groupBy("p_type").agg(F.median("p_retailprice").alias("m")).crossJoin(F.broadcast(p.agg(F.median("p_retailprice").alias("a"))))
    return m.select("p_type", r("m").alias("med"), (F.col("m") <= F.col("a")).alias("ok"))
