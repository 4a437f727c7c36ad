"""Registered queries over the driver's tables and the SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import headers as H
from .functions import scalars as S
from .operators import evaluate as E
from .operators import fields as G
from .operators import match as M
from .operators import stations as ST
from .operators import surfaces as U
from .sources import adapters as A

QUERIES: dict = {}
ORACLE: dict = {}
COVARIATES = ["sst", "chl", "uo", "vo"]


def query(sql: str | None = None):
    """Register a function under its name, with SQL over the shared views below."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql if sql.lstrip().upper().startswith("WITH RECURSIVE") else VIEWS + sql
        return f
    return add


VIEWS = """
WITH stations AS (
  SELECT o_orderkey AS station_id, -76000000 + 22500 * ((o_orderkey * 37) % 101) AS lon_u, 35000000 + 22500 * ((o_custkey * 53) % 101) AS lat_u,
    CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day,
    o_totalprice AS abundance, o_orderpriority AS dataset FROM orders
), g0 AS (
  SELECT CAST(l_suppkey % 100 AS INTEGER) AS cell, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS sst, CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS chl,
    CAST(sum(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) / count(*) - 0.04::DOUBLE AS uo, CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*) - 0.05::DOUBLE AS vo
  FROM lineitem GROUP BY 1, 2, 3
), grid AS (
  SELECT *, cell % 10 AS ix, cell // 10 AS iy, -76000000::BIGINT + 250000 * (cell % 10) AS lon_u, 35000000::BIGINT + 250000 * (cell // 10) AS lat_u FROM g0
), gappy AS (SELECT * REPLACE (CASE WHEN (cell + month) % 3 <> 0 THEN chl END AS chl) FROM grid
), coarse AS (
  SELECT year, month, ix // 2 AS ix, iy // 2 AS iy, (iy // 2) * 5 + ix // 2 AS cell, -75875000::BIGINT + 500000 * (ix // 2) AS lon_u, 35125000::BIGINT + 500000 * (iy // 2) AS lat_u,
    CAST(sum(CAST(chl AS DECIMAL(28,10))) AS DOUBLE) / count(chl) AS chl FROM grid GROUP BY year, month, ix // 2, iy // 2
), scores AS (
  SELECT o_orderkey AS station_id, CAST((o_orderkey * 7919) % 101 + (o_custkey * 31) % 100 > 120 AS INTEGER) AS label, CAST((o_orderkey * 7919) % 101 AS DOUBLE) / 100 AS score FROM orders
), runs AS (
  SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY score
), curve AS (
  SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM runs WINDOW w AS (ORDER BY score DESC)
), folded AS (
  SELECT *, (row_number() OVER (PARTITION BY label ORDER BY (station_id * 104729) % 1000003, station_id) - 1) % 5 AS fold FROM scores
), pairs AS (
  SELECT s.*, g.cell, g.sst, g.chl, g.uo, g.vo, (s.lon_u - g.lon_u) * (s.lon_u - g.lon_u) + (s.lat_u - g.lat_u) * (s.lat_u - g.lat_u) AS dist2
  FROM stations s JOIN grid g ON s.year = g.year AND s.month = g.month
), matched AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY dist2, cell) AS r FROM pairs) WHERE r = 1
), idx AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS idx FROM orders GROUP BY 1, 2
), static AS (
  SELECT cell, CASE WHEN d >= 0 THEN d END AS depth FROM (SELECT CAST(s_suppkey % 100 AS INTEGER) AS cell, max(s_acctbal) AS d FROM supplier GROUP BY 1)
)
"""


def _matched(spark, d, left=False):
    return M.nearest(A.stations(spark, d), ["station_id"], A.grid(spark, d), COVARIATES, A.LATTICE, left=left)


def r6(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


# --- scans, filters, scalars


@query("""SELECT station_id, lon_u / 1e6 AS lon, lat_u / 1e6 AS lat, year, month, day, abundance, dataset, CAST(dayofyear(make_date(year, month, day)) AS INTEGER) AS jday FROM stations
WHERE year BETWEEN 1996 AND 1999 AND month BETWEEN 3 AND 10 AND lon_u / 1e6 BETWEEN -75.5 AND -74.2 AND lat_u / 1e6 BETWEEN 35.3 AND 36.9 AND dataset IN ('1-URGENT', '2-HIGH')""")
def stations_window(spark, d):
    s = A.degrees(A.stations(spark, d)).drop("lon_u", "lat_u")
    return ST.stations(s, (1996, 1999), (3, 10), (-75.5, -74.2), (35.3, 36.9), ["1-URGENT", "2-HIGH"]).select("station_id", "lon", "lat", "year", "month", "day", "abundance", "dataset", "jday")


@query("SELECT station_id, lon_u / 1e6 AS lon FROM stations")
def lon_sign_fix(spark, d):
    s = A.degrees(A.stations(spark, d))
    return s.withColumn("lon", F.when(F.col("station_id") % 2 == 1, -F.col("lon")).otherwise(F.col("lon"))).select("station_id", S.sign_fixed(F.col("lon")).alias("lon"))


@query("""SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, 0.0) + coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END, 0.0) + coalesce(l_discount, 0.0), 6) AS abundance FROM lineitem""")
def stage_sum(spark, d):
    li = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x_CI"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax")).alias("x_CII"), F.col("l_discount").alias("x_CIII"))
    return li.select("l_orderkey", "l_linenumber", F.round(S.stage_sum(ST.stage_columns(li, "x")), 6).alias("abundance"))


@query("SELECT cell, year, month, round(sst, 6) AS sst, round(chl, 6) AS chl FROM gappy WHERE sst IS NOT NULL AND chl IS NOT NULL")
def complete_cases(spark, d):
    return ST.complete(A.gappy(A.grid(spark, d)), ["sst", "chl", "absent"]).select("cell", "year", "month", *r6("sst", "chl"))


@query("""SELECT cell, lon_u, lat_u, g.year, g.month, 15 AS day, CAST(dayofyear(make_date(g.year, g.month, 15)) AS INTEGER) AS jday, round(sst, 6) AS sst, round(idx, 6) AS idx
FROM grid g LEFT JOIN idx i ON g.year = i.year AND g.month = i.month WHERE g.year = 1997 AND g.month = 6""")
def grid_month_slice(spark, d):
    return M.index_join(G.month_slice(A.grid(spark, d), 1997, 6), A.index_series(spark, d)).select("cell", "lon_u", "lat_u", "year", "month", "day", "jday", *r6("sst", "idx"))


@query("SELECT CASE WHEN month <= 3 THEN 1 WHEN month <= 6 THEN 2 WHEN month <= 9 THEN 3 ELSE 4 END AS season, count(*) AS n FROM stations GROUP BY 1")
def season_bucket(spark, d):
    return A.stations(spark, d).groupBy(S.season(F.col("month")).alias("season")).agg(F.count("*").alias("n"))


@query("""SELECT station_id, year, month, CASE WHEN station_id % 7 = 0 THEN NULL ELSE CAST(dayofyear(make_date(year, month, day)) AS INTEGER) END AS jday FROM stations""")
def jday(spark, d):
    day = F.when(F.col("station_id") % 7 == 0, F.lit(32)).otherwise(F.col("day"))
    return A.stations(spark, d).select("station_id", "year", "month", S.jday(F.col("year"), F.col("month"), day).alias("jday"))


@query("SELECT station_id, CASE WHEN station_id % 11 <> 0 THEN year END AS year, CASE WHEN station_id % 11 <> 0 THEN month END AS month, CASE WHEN station_id % 11 <> 0 THEN day END AS day FROM stations")
def split_dates(spark, d):
    s = A.stations(spark, d)
    names = F.array(*[F.lit(m) for m in S.MONTHS])
    text = F.concat_ws("-", F.lpad(F.col("day").cast("string"), 2, "0"), names[F.col("month") - 1], F.lpad((F.col("year") % 100).cast("string"), 2, "0"))
    text = F.when(F.col("station_id") % 11 == 0, F.lit("31-FEB-03")).otherwise(text)
    y, m, day = S.split_date(F.col("t"))
    return s.select("station_id", text.alias("t")).select("station_id", y.alias("year"), m.alias("month"), day.alias("day"))


@query("""SELECT station_id, lon_u / 1e6 AS lon, lat_u / 1e6 AS lat, year, month, day, round(abundance / 10, 6) AS cfin_total FROM stations""")
def format_raw(spark, d):
    from .sources.readers import format_stations

    s = A.degrees(A.stations(spark, d))
    names = F.array(*[F.lit(m) for m in S.MONTHS])
    date = F.concat_ws("-", F.lpad(F.col("day").cast("string"), 2, "0"), names[F.col("month") - 1], F.lpad((F.col("year") % 100).cast("string"), 2, "0"))
    raw = s.select(F.col("station_id").alias("STATION"), F.col("lat").alias("LATITUDE"), F.col("lon").alias("LONGITUDE"), date.alias("DATE"), F.col("abundance").alias("CALANUS_FINMARCHICUS_10M2"))
    return format_stations(raw).select(F.col("station").alias("station_id"), "lon", "lat", "year", "month", "day", F.round("cfin_total", 6).alias("cfin_total"))


@query(""", names AS (SELECT p_name, string_split_regex(lower(p_name), '[ _]+') AS w FROM (SELECT p_name FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part)
), short AS (SELECT p_name, w, CASE WHEN len(w) > 1 THEN substr(w[1], 1, 1) || substr(w[2], 1, 3) ELSE substr(w[1], 1, 4) END AS s FROM names
), longer AS (SELECT p_name, s, m, CASE WHEN len(w) > 1 THEN substr(w[1], 1, 3 + m) || substr(w[2], 1, 3) ELSE substr(w[1], 1, 6 + m) END AS t FROM short, (SELECT unnest(range(13)) AS m)
), chosen AS (SELECT s, min(m) AS m FROM (SELECT s, m FROM longer GROUP BY s, m HAVING count(DISTINCT t) = count(*) AND count(*) > 1) GROUP BY s)
SELECT x.p_name, coalesce(l.t, x.s) AS short_name FROM short x LEFT JOIN chosen c ON x.s = c.s LEFT JOIN longer l ON l.p_name = x.p_name AND l.m = c.m""")
def taxon_shorthand(spark, d):
    parts = A.table(spark, d, "part")
    names = parts.select("p_name").union(parts.select(F.split_part("p_name", F.lit(" "), F.lit(1)))).distinct()
    longer = F.array(*[S.shorthand(F.col("p_name"), m) for m in range(H.LONGER)])
    names = names.select("p_name", S.shorthand(F.col("p_name")).alias("s"), longer.alias("longer"))
    kinds = names.groupBy("s").agg(F.count("*").alias("n"), *[F.count_distinct(F.get("longer", F.lit(m))).alias(f"k{m}") for m in range(H.LONGER)])
    more = F.when(F.col("n") > 1, F.coalesce(*[F.when(F.col(f"k{m}") == F.col("n"), F.lit(m)) for m in range(H.LONGER)]))
    return names.join(kinds.select("s", more.alias("m")), "s").select("p_name", F.coalesce(F.get("longer", F.col("m")), F.col("s")).alias("short_name"))


@query("""SELECT station_id, round(ln(1 + abs(chl)), 6) AS log1p, round(ln(abs(sst)), 6) AS log, round(log10(abs(sst)), 6) AS log10, round(sqrt(abs(chl)), 6) AS sqrt, round(pow(abs(sst), 0.25), 6) AS fourth_root,
  CASE WHEN uo = 0 THEN NULL ELSE round(ln(abs(uo)), 5) END AS abs_log FROM matched""")
def transforms(spark, d):
    m = _matched(spark, d)
    of = {"log1p": "chl", "log": "sst", "log10": "sst", "sqrt": "chl", "fourth_root": "sst", "abs_log": "uo"}
    return m.select("station_id", *[F.round(S.transform(t, F.col(c)), 5 if t == "abs_log" else 6).alias(t) for t, c in of.items()])


@query("SELECT cell, year, month, round(sqrt(uo * uo + vo * vo), 6) AS speed FROM grid")
def current_speed(spark, d):
    return A.grid(spark, d).select("cell", "year", "month", F.round(S.speed(F.col("uo"), F.col("vo")), 6).alias("speed"))


@query("SELECT g.cell, year, month, round((sst - chl) / CASE WHEN depth <> 0 THEN depth END, 8) AS sst_dz FROM grid g LEFT JOIN static s ON g.cell = s.cell")
def vertical_gradient(spark, d):
    g = A.grid(spark, d).join(A.static(spark, d), "cell", "left")
    return g.select("cell", "year", "month", F.round(S.vertical_gradient(F.col("sst"), F.col("chl"), F.col("depth")), 8).alias("sst_dz"))


@query("SELECT station_id, CAST(floor((lon_u / 1e6 + 77) / 0.25) + 1 AS INTEGER) AS i, CAST(floor((38 - lat_u / 1e6) / 0.25) + 1 AS INTEGER) AS j FROM stations")
def latlon2cell(spark, d):
    s = A.degrees(A.stations(spark, d))
    i, j = S.cell_index(F.col("lon"), F.col("lat"), -77.0, 38.0, 0.25, 0.25)
    return s.select("station_id", i.alias("i"), j.alias("j"))


# --- joins


@query("SELECT station_id, cell, dist2, round(sst, 6) AS sst, round(chl, 6) AS chl FROM matched")
def nearest_match(spark, d):
    return _matched(spark, d).select("station_id", "cell", "dist2", *r6("sst", "chl"))


@query("""SELECT s.station_id, m.cell, m.dist2, round(m.sst, 6) AS sst FROM (SELECT * REPLACE (CASE WHEN station_id % 13 = 0 THEN year + 50 ELSE year END AS year) FROM stations) s
LEFT JOIN (SELECT * FROM matched WHERE station_id % 13 <> 0) m ON s.station_id = m.station_id""")
def nearest_match_left(spark, d):
    s = A.stations(spark, d).withColumn("year", F.when(F.col("station_id") % 13 == 0, F.col("year") + 50).otherwise(F.col("year")))
    return M.nearest(s, ["station_id"], A.grid(spark, d), ["sst"], A.LATTICE, left=True).select("station_id", "cell", "dist2", *r6("sst"))


@query("""SELECT cell, year, month, round(sst, 6) AS sst, round(chl_c, 9) AS chl FROM (
  SELECT f.cell, f.year, f.month, f.sst, c.chl AS chl_c, row_number() OVER (PARTITION BY f.cell, f.year, f.month ORDER BY (f.lon_u - c.lon_u) * (f.lon_u - c.lon_u) + (f.lat_u - c.lat_u) * (f.lat_u - c.lat_u), c.cell) AS r
  FROM grid f LEFT JOIN (SELECT * FROM coarse WHERE month <> 2) c ON f.year = c.year AND f.month = c.month) WHERE r = 1""")
def product_join(spark, d):
    g = A.grid(spark, d)
    fine = g.select(F.col("cell").alias("fine"), "year", "month", "lon_u", "lat_u", "sst")
    return M.nearest(fine, ["fine", "year", "month"], A.coarse(g).filter("month <> 2"), ["chl"], A.COARSE, left=True).select(F.col("fine").alias("cell"), "year", "month", *r6("sst"), *r6("chl", digits=9))


@query("""SELECT cell, year, month, round(chl, 9) AS chl, round(sst, 6) AS sst FROM (
  SELECT c.cell, c.year, c.month, c.chl, f.sst, row_number() OVER (PARTITION BY c.cell, c.year, c.month ORDER BY (f.lon_u - c.lon_u) * (f.lon_u - c.lon_u) + (f.lat_u - c.lat_u) * (f.lat_u - c.lat_u), f.cell) AS r
  FROM coarse c LEFT JOIN grid f ON f.year = c.year AND f.month = c.month) WHERE r = 1""")
def product_join_coarsest(spark, d):
    g = A.grid(spark, d)
    points = A.coarse(g).select(F.col("cell").alias("big"), "year", "month", "lon_u", "lat_u", "chl")
    return M.nearest(points, ["big", "year", "month"], g, ["sst"], A.LATTICE, left=True).select(F.col("big").alias("cell"), "year", "month", *r6("sst"), *r6("chl", digits=9))


@query("SELECT station_id, s.year, s.month, round(idx, 6) AS idx FROM stations s LEFT JOIN (SELECT * FROM idx WHERE month <> 4) i ON s.year = i.year AND s.month = i.month")
def climate_join(spark, d):
    return M.index_join(A.stations(spark, d), A.index_series(spark, d).filter("month <> 4")).select("station_id", "year", "month", *r6("idx"))


@query("SELECT station_id, m.cell, round(depth, 6) AS depth FROM matched m JOIN static s ON m.cell = s.cell WHERE depth IS NOT NULL")
def static_attach(spark, d):
    m = _matched(spark, d).select("station_id", "cell").join(A.static(spark, d), "cell", "left")
    return ST.complete(m, ["depth"]).select("station_id", "cell", *r6("depth"))


@query("""SELECT f.cell, f.year, f.month, round(coalesce(f.chl, c.chl), 9) AS chl, CASE WHEN f.chl IS NOT NULL THEN 'satellite' WHEN c.chl IS NOT NULL THEN 'model' END AS chl_source
FROM gappy f LEFT JOIN coarse c ON f.year = c.year AND f.month = c.month AND c.ix = f.ix // 2 AND c.iy = f.iy // 2""")
def fill_gaps(spark, d):
    g = A.grid(spark, d)
    fine = A.gappy(g).select(F.col("cell").alias("fine"), "year", "month", "lon_u", "lat_u", "chl")
    both = M.nearest(fine, ["fine", "year", "month"], A.coarse(g).withColumnRenamed("chl", "model_chl"), ["model_chl"], A.COARSE, left=True)
    return M.filled(both, "chl", "model_chl").select(F.col("fine").alias("cell"), "year", "month", *r6("chl", digits=9), "chl_source")


@query("""SELECT station_id, cell FROM stations s JOIN grid g ON s.year = g.year AND s.month = g.month AND (s.lon_u + 76000000 + 50000) // 100000 = (g.lon_u + 76000000 + 50000) // 100000
AND (s.lat_u + 50000) // 100000 = (g.lat_u + 50000) // 100000""")
def rounded_join(spark, d):
    key = lambda df: df.withColumns({"kx": M.rounded_key(F.col("lon_u")), "ky": M.rounded_key(F.col("lat_u"))})
    return key(A.stations(spark, d)).join(key(A.grid(spark, d)).select("cell", "year", "month", "kx", "ky"), ["year", "month", "kx", "ky"]).select("station_id", "cell")


_FLAGS = """, flags AS (SELECT l_returnflag AS f, CAST(l_suppkey % 100 AS INTEGER) AS cell, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q FROM lineitem GROUP BY 1, 2, 3, 4),
a AS (SELECT cell, year, month, q AS taxon_a FROM flags WHERE f = 'A'), n AS (SELECT cell, year, month, q AS taxon_n FROM flags WHERE f = 'N'), r AS (SELECT cell, year, month, q AS taxon_r FROM flags WHERE f = 'R')
"""


def _flags(spark, d):
    li = A.table(spark, d, "lineitem").select("l_returnflag", (F.col("l_suppkey") % 100).cast("int").alias("cell"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), "l_quantity")
    return [li.filter(F.col("l_returnflag") == f).groupBy("cell", "year", "month").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias(f"taxon_{f.lower()}")) for f in "ANR"]


@query(_FLAGS + "SELECT * FROM a FULL JOIN n USING (cell, year, month) FULL JOIN r USING (cell, year, month)")
def taxa_full_outer(spark, d):
    return M.folded(_flags(spark, d), ["cell", "year", "month"], "full_outer")


@query(_FLAGS + "SELECT * FROM a JOIN n USING (cell, year, month) JOIN r USING (cell, year, month)")
def covariate_inner_fold(spark, d):
    return M.folded(_flags(spark, d), ["cell", "year", "month"], "inner")


# --- aggregates and sets

_MEANS = """, means AS (SELECT covariate, year, month, CAST(sum(CAST(v AS DECIMAL(28,10))) AS DOUBLE) / count(v) AS mean FROM (
  SELECT year, month, unnest(['sst', 'chl', 'uo', 'vo']) AS covariate, unnest([sst, chl, uo, vo]) AS v FROM gappy) GROUP BY ALL)
"""


@query(_MEANS + "SELECT covariate, year, month, round(mean, 6) AS mean FROM means")
def monthly_means(spark, d):
    return G.monthly_means(A.gappy(A.grid(spark, d)), COVARIATES).select("covariate", "year", "month", *r6("mean"))


@query(_MEANS + "SELECT covariate, year, round(CAST(sum(CAST(mean AS DECIMAL(28,10))) AS DOUBLE) / count(mean), 6) AS mean FROM means GROUP BY ALL")
def annual_means(spark, d):
    return G.annual_means(G.monthly_means(A.gappy(A.grid(spark, d)), COVARIATES)).select("covariate", "year", *r6("mean"))


@query("SELECT cell, month, round(CAST(sum(CAST(sst AS DECIMAL(28,10))) AS DOUBLE) / count(sst), 6) AS sst, round(CAST(sum(CAST(chl AS DECIMAL(28,10))) AS DOUBLE) / count(chl), 6) AS chl FROM gappy GROUP BY cell, month")
def climatology(spark, d):
    return G.climatology(A.gappy(A.grid(spark, d)), ["sst", "chl"]).select("cell", "month", *r6("sst", "chl"))


_CUT = """, cut AS (SELECT q AS raw, CASE WHEN q < 1500 THEN q ELSE round_even(q / 1000, 0) * 1000 END AS threshold FROM (SELECT quantile_cont(abundance, 0.9) AS q FROM matched))
"""


@query(_CUT + "SELECT round(raw, 6) AS raw, round(threshold, 6) AS threshold FROM cut")
def threshold(spark, d):
    cut = ST.percentile_of(_matched(spark, d).select("abundance"), 0.9)
    return spark.range(1).select(F.round(F.lit(cut), 6).alias("raw"), F.round(S.rounded_threshold(F.lit(cut)), 6).alias("threshold"))


def _labelled(spark, d):
    m = _matched(spark, d)
    return ST.labelled(m, ST.threshold(m.select("abundance")))


@query(_CUT + "SELECT station_id, cell, abundance, CASE WHEN abundance >= threshold THEN 'patch' ELSE 'non_patch' END AS patch, round(threshold, 6) AS threshold FROM matched, cut")
def label_patch(spark, d):
    return _labelled(spark, d).select("station_id", "cell", "abundance", "patch", *r6("threshold"))


@query(_CUT + "SELECT CASE WHEN abundance >= threshold THEN 'patch' ELSE 'non_patch' END AS patch, count(*) AS n FROM matched, cut GROUP BY 1")
def class_counts(spark, d):
    return ST.class_counts(_labelled(spark, d))


@query("""SELECT count(*) AS n, min(year) AS first_year, max(year) AS last_year, count(DISTINCT month) AS n_months, min(lon_u / 1e6) AS west, max(lon_u / 1e6) AS east, min(lat_u / 1e6) AS south, max(lat_u / 1e6) AS north,
round(median(abundance), 6) AS median, round(quantile_cont(abundance, 0.9), 6) AS p90, max(abundance) AS largest, round(100.0 * count(CASE WHEN abundance = 0 THEN 1 END) / count(abundance), 6) AS percent_zero FROM stations""")
def station_summary(spark, d):
    return ST.summary(A.degrees(A.stations(spark, d)))


@query("SELECT year, month, round(median(abundance), 6) AS median, round(year + (month - 0.5::DOUBLE) / 12, 6) AS x FROM stations GROUP BY year, month")
def station_series(spark, d):
    return ST.monthly_median(A.stations(spark, d))


@query("SELECT lon_u, lat_u, first(station_id ORDER BY abundance DESC, station_id) AS station_id, first(abundance ORDER BY abundance DESC, station_id) AS abundance FROM stations GROUP BY lon_u, lat_u")
def distinct_keep_first(spark, d):
    s = A.stations(spark, d).select("lon_u", "lat_u", "station_id", "abundance")
    return ST.first_of(s, ["lon_u", "lat_u"], [-F.col("abundance"), F.col("station_id")])


@query("""SELECT y AS year, m AS month FROM (SELECT DISTINCT year AS y FROM stations UNION SELECT DISTINCT year FROM grid), (SELECT DISTINCT month AS m FROM stations WHERE month BETWEEN 3 AND 5 UNION SELECT DISTINCT month FROM grid WHERE month BETWEEN 9 AND 10)""")
def period_union(spark, d):
    s, g = A.stations(spark, d), A.grid(spark, d)
    years = s.select("year").union(g.select("year")).distinct()
    months = s.select("month").filter("month between 3 and 5").union(g.select("month").filter("month between 9 and 10")).distinct()
    return years.join(F.broadcast(months))  # twelve months at most


@query("""SELECT 'stations' AS source, station_id AS id, year, month, abundance, CAST(NULL AS DOUBLE) AS sst FROM stations
UNION ALL SELECT 'grid', cell, year, month, NULL, round(sst, 6) FROM grid""")
def source_union(spark, d):
    s = A.stations(spark, d).select(F.lit("stations").alias("source"), F.col("station_id").alias("id"), "year", "month", "abundance")
    g = A.grid(spark, d).select(F.lit("grid").alias("source"), F.col("cell").cast("long").alias("id"), "year", "month", *r6("sst"))
    return s.unionByName(g, allowMissingColumns=True)


@query("""SELECT variable, n_distinct, CASE WHEN n_distinct > 10 THEN 'smooth' ELSE 'linear' END AS term FROM (SELECT unnest(['sst', 'chl', 'cell', 'month', 'year']) AS variable,
unnest([count(DISTINCT sst), count(DISTINCT chl), count(DISTINCT cell), count(DISTINCT month), count(DISTINCT year)]) AS n_distinct FROM matched)""")
def distinct_gate(spark, d):
    return U.distinct_gate(_matched(spark, d), ["sst", "chl", "cell", "month", "year"])


@query("""SELECT lon_step, lat_step, greatest(lon_step, lat_step) AS spacing FROM
(SELECT median(gap) / 1e6 AS lon_step FROM (SELECT v - lag(v) OVER (ORDER BY v) AS gap FROM (SELECT DISTINCT lon_u AS v FROM grid))),
(SELECT median(gap) / 1e6 AS lat_step FROM (SELECT v - lag(v) OVER (ORDER BY v) AS gap FROM (SELECT DISTINCT lat_u AS v FROM grid)))""")
def grid_spacing(spark, d):
    return G.spacing(A.grid(spark, d))


@query("""SELECT cell, year, month, round(sst, 6) AS sst FROM grid JOIN (SELECT cell FROM (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT cell FROM grid))
WHERE n <= 30 OR r % CAST(ceil(n / 30.0) AS BIGINT) = 0) USING (cell)""")
def thin_grid(spark, d):
    return G.thinned(A.grid(spark, d), 30).select("cell", "year", "month", *r6("sst"))


# --- derived fields


@query("SELECT cell, year, month, round(lag(sst, 1) OVER (PARTITION BY cell ORDER BY year, month), 6) AS sst_lag1 FROM grid")
def lag1(spark, d):
    return G.lagged(A.grid(spark, d), "sst").select("cell", "year", "month", *r6("sst_lag1"))


@query("SELECT cell, year, month, round(lag(sst, 12) OVER (PARTITION BY cell ORDER BY year, month), 6) AS sst_lag12 FROM grid")
def lag12(spark, d):
    return G.lagged(A.grid(spark, d), "sst", 12).select("cell", "year", "month", *r6("sst_lag12"))


@query("""SELECT cell, year, month, round((sst - lag(sst) OVER w) / (year * 12 + month - lag(year * 12 + month) OVER w), 6) AS sst_dt FROM grid WINDOW w AS (PARTITION BY cell ORDER BY year, month)""")
def temporal_gradient(spark, d):
    return G.temporal_gradient(A.grid(spark, d), "sst").select("cell", "year", "month", *r6("sst_dt"))


@query("SELECT cell, year, month, round(CAST(sum(CAST(chl AS DECIMAL(28,10))) OVER (PARTITION BY cell, year ORDER BY month) AS DOUBLE), 6) AS chl_int FROM gappy")
def integral_year(spark, d):
    return G.integral(A.gappy(A.grid(spark, d)), "chl").select("cell", "year", "month", *r6("chl_int"))


@query("""SELECT cell, year, month, CASE WHEN count(*) OVER w = count(chl) OVER w THEN round(CAST(sum(CAST(chl AS DECIMAL(28,10))) OVER w AS DOUBLE), 6) END AS chl_int FROM gappy WINDOW w AS (PARTITION BY cell, year ORDER BY month)""")
def integral_legacy(spark, d):
    return G.integral_strict(A.gappy(A.grid(spark, d)), "chl").select("cell", "year", "month", *r6("chl_int"))


@query("""SELECT g.cell, year, month, round(0.5 * ((uo - mu) * (uo - mu) + (vo - mv) * (vo - mv)), 6) AS eke FROM grid g
JOIN (SELECT cell, CAST(sum(CAST(uo AS DECIMAL(28,10))) AS DOUBLE) / count(uo) AS mu, CAST(sum(CAST(vo AS DECIMAL(28,10))) AS DOUBLE) / count(vo) AS mv FROM grid GROUP BY cell) m ON g.cell = m.cell""")
def eke(spark, d):
    return G.eke(A.grid(spark, d), "uo", "vo").select("cell", "year", "month", *r6("eke"))


_NEAR = """, near AS (SELECT c.*, w.sst AS west, e.sst AS east, s.sst AS south, n.sst AS north FROM grid c
  LEFT JOIN grid w ON w.year = c.year AND w.month = c.month AND w.iy = c.iy AND w.ix = c.ix - 1 LEFT JOIN grid e ON e.year = c.year AND e.month = c.month AND e.iy = c.iy AND e.ix = c.ix + 1
  LEFT JOIN grid s ON s.year = c.year AND s.month = c.month AND s.ix = c.ix AND s.iy = c.iy - 1 LEFT JOIN grid n ON n.year = c.year AND n.month = c.month AND n.ix = c.ix AND n.iy = c.iy + 1
), grad AS (SELECT *, sqrt(gx * gx + gy * gy) AS grad FROM (SELECT *, (east - west) / (0.5 * 111.32::DOUBLE * cos(radians(lat_u / 1e6))) AS gx, (north - south) / (0.5 * 111.32::DOUBLE) AS gy FROM near))
"""


@query(_NEAR + "SELECT cell, year, month, round(grad, 6) AS sst_grad FROM grad")
def horizontal_gradient(spark, d):
    return G.horizontal_gradient(A.grid(spark, d), "sst", A.CELL).select("cell", "year", "month", *r6("sst_grad"))


_TO = """SELECT c.cell, c.year, c.month, round(sqrt(min(((c.lon_u - f.lon_u) / 1e6 * cos(radians(c.lat_u / 1e6))) * ((c.lon_u - f.lon_u) / 1e6 * cos(radians(c.lat_u / 1e6))) + (c.lat_u - f.lat_u) / 1e6 * ((c.lat_u - f.lat_u) / 1e6))) * 111.32, 5) AS {0}
FROM grid c LEFT JOIN mask f ON f.year = c.year AND f.month = c.month GROUP BY c.cell, c.year, c.month"""


@query(_NEAR + ", mask AS (SELECT g.* FROM grad g JOIN (SELECT year, month, median(grad) AS cut FROM grad GROUP BY year, month) q ON g.year = q.year AND g.month = q.month WHERE grad > cut)" + _TO.format("front_dist"))
def front_distance(spark, d):
    return G.front_distance(A.grid(spark, d), "sst", A.CELL).select("cell", "year", "month", *r6("front_dist", digits=5))


@query(_NEAR + """, mask AS (SELECT * FROM near WHERE (west >= 25.5) <> (sst >= 25.5) OR (east >= 25.5) <> (sst >= 25.5) OR (south >= 25.5) <> (sst >= 25.5) OR (north >= 25.5) <> (sst >= 25.5))""" + _TO.format("contour_dist"))
def contour_distance(spark, d):
    return G.contour_distance(A.grid(spark, d), "sst", 25.5).select("cell", "year", "month", *r6("contour_dist", digits=5))


@query("SELECT year, month, ix AS cx, iy AS cy, round(chl, 9) AS chl FROM coarse")
def upscale_mean(spark, d):
    return G.upscaled(A.grid(spark, d), "chl", 2).select("year", "month", "cx", "cy", *r6("chl", digits=9))


@query("SELECT year, month, ix // 2 AS cx, iy // 2 AS cy, round(median(chl), 6) AS chl FROM grid GROUP BY ALL")
def upscale_median(spark, d):
    return G.upscaled(A.grid(spark, d), "chl", 2, "median").select("year", "month", "cx", "cy", *r6("chl"))


@query("SELECT year, month, 2 * ix + i AS ix, 2 * iy + j AS iy, round(chl, 9) AS chl FROM coarse, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)")
def downscale_nearest(spark, d):
    c = G.upscaled(A.grid(spark, d), "chl", 2)
    return G.downscaled_nearest(c, "chl", 2).select("year", "month", "ix", "iy", *r6("chl", digits=9))


@query("""SELECT f.cell, f.year, f.month, CASE WHEN count(c.chl) = 4 THEN round(sum(CASE WHEN k.i = 1 THEN fx ELSE 1 - fx END * CASE WHEN k.j = 1 THEN fy ELSE 1 - fy END * c.chl) + 1e-12, 8) END AS chl
FROM (SELECT *, (ix - 0.5::DOUBLE) / 2 - floor((ix - 0.5::DOUBLE) / 2) AS fx, (iy - 0.5::DOUBLE) / 2 - floor((iy - 0.5::DOUBLE) / 2) AS fy, floor((ix - 0.5::DOUBLE) / 2) AS x0, floor((iy - 0.5::DOUBLE) / 2) AS y0 FROM grid) f
CROSS JOIN (SELECT * FROM (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)) k LEFT JOIN coarse c ON c.year = f.year AND c.month = f.month AND c.ix = f.x0 + k.i AND c.iy = f.y0 + k.j GROUP BY f.cell, f.year, f.month""")
def downscale_bilinear(spark, d):
    g = A.grid(spark, d)
    return G.downscaled_bilinear(g, A.coarse(g), "chl", A.COARSE).select("cell", "year", "month", F.round(F.col("chl") + 1e-12, 8).alias("chl"))  # exact halves go up in both engines


# --- evaluation


@query("SELECT CAST(greatest(ceil(score * 10), 1) AS INTEGER) AS bin, round(CAST(sum(CAST(score AS DECIMAL(28,10))) AS DOUBLE) / count(*), 6) AS predicted, round(CAST(sum(label) AS DOUBLE) / count(*), 6) AS observed, count(*) AS n FROM scores GROUP BY 1")
def calibration(spark, d):
    return E.calibration(A.scores(spark, d)).select("bin", *r6("predicted", "observed"), "n")


_COUNTS = """SELECT *, tp / nullif(tp + fn, 0)::DOUBLE AS sens, tn / nullif(tn + fp, 0)::DOUBLE AS spec, tp / nullif(tp + fp, 0)::DOUBLE AS precision FROM (
SELECT {0} count(CASE WHEN score >= 0.5 AND label = 1 THEN 1 END) AS tp, count(CASE WHEN score >= 0.5 AND label = 0 THEN 1 END) AS fp, count(CASE WHEN score < 0.5 AND label = 1 THEN 1 END) AS fn, count(CASE WHEN score < 0.5 AND label = 0 THEN 1 END) AS tn FROM {1})"""


@query(", m AS (" + _COUNTS.format("", "scores") + ") SELECT unnest(['sens', 'spec', 'tss', 'precision']) AS metric, unnest([round(sens, 6), round(spec, 6), round(sens + spec - 1, 6), round(precision, 6)]) AS value FROM m")
def confusion_default(spark, d):
    return E.metrics_at(A.scores(spark, d), 0.5).select("metric", *r6("value"))


@query("SELECT score AS cutoff, round(tp / p::DOUBLE - fp / n::DOUBLE, 6) AS tss FROM curve ORDER BY tp / p::DOUBLE + (1 - fp / n::DOUBLE) - 1 DESC, score DESC LIMIT 1")
def best_cutoff(spark, d):
    return E.best_cutoff(A.scores(spark, d)).select("cutoff", *r6("tss"))


@query("SELECT round(sum(pos * (n - fp) + pos * neg / 2.0::DOUBLE) / (max(p) * max(n)), 6) AS roc_auc FROM curve")
def roc_auc(spark, d):
    return E.roc_auc(A.scores(spark, d)).select(*r6("roc_auc"))


_PR = """SELECT sum(pos / p::DOUBLE * (tp / (tp + fp)::DOUBLE + CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg)::DOUBLE ELSE 1.0 END) / 2) AS v FROM curve"""


@query("SELECT round(v, 6) AS pr_auc FROM (" + _PR + ")")
def pr_auc(spark, d):
    return E.pr_auc(A.scores(spark, d)).select(*r6("pr_auc"))


@query("SELECT score, round(tp / p::DOUBLE, 6) AS sensitivity, round(1 - fp / n::DOUBLE, 6) AS specificity FROM curve")
def roc_curve(spark, d):
    return E.roc_curve(A.scores(spark, d)).select("score", *r6("sensitivity", "specificity"))


@query("SELECT score, round(tp / p::DOUBLE, 6) AS recall, round(tp / (tp + fp)::DOUBLE, 6) AS precision FROM curve")
def pr_curve(spark, d):
    return E.pr_curve(A.scores(spark, d)).select("score", *r6("recall", "precision"))


@query("SELECT score, round(tp / p::DOUBLE, 6) AS sens, round(1 - fp / n::DOUBLE, 6) AS spec, round(tp / p::DOUBLE + (1 - fp / n::DOUBLE) - 1, 6) AS tss FROM curve")
def threshold_curve(spark, d):
    return E.threshold_curve(A.scores(spark, d)).select("score", *r6("sens", "spec", "tss"))


def _folded(spark, d):
    return E.stratified_folds(A.scores(spark, d), 5, (F.col("station_id") * 104729) % 1000003)


@query("SELECT station_id, label, CAST(fold AS INTEGER) AS fold FROM folded")
def stratified_folds(spark, d):
    return _folded(spark, d).select("station_id", "label", "fold")


_FOLDS = """, per AS (""" + _COUNTS.format("fold,", "folded GROUP BY fold") + """), kap AS (
  SELECT fold, sens, spec, ((tp + tn) / n - pe) / (1 - pe) AS kap FROM (SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM (SELECT *, (tp + fp + fn + tn)::DOUBLE AS n FROM per))
), auc AS (
  SELECT fold, sum(pos * coalesce(below, 0) + pos * neg / 2.0::DOUBLE) / (sum(pos) * sum(neg)) AS roc_auc FROM (SELECT *, sum(neg) OVER (PARTITION BY fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
    FROM (SELECT fold, score, sum(label) AS pos, sum(1 - label) AS neg FROM folded GROUP BY fold, score)) GROUP BY fold
), longer AS (SELECT fold, unnest(['roc_auc', 'kap', 'sens', 'spec']) AS metric, unnest([roc_auc, kap, sens, spec]) AS value FROM kap JOIN auc USING (fold)
), fm AS (SELECT metric, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS std_err, count(value) AS n FROM longer GROUP BY metric
), fmt AS (SELECT * FROM fm UNION ALL SELECT 'tss', (SELECT mean FROM fm WHERE metric = 'sens') + (SELECT mean FROM fm WHERE metric = 'spec') - 1, NULL, 5)
"""


@query(_FOLDS + "SELECT metric, round(mean, 6) AS mean, round(std_err, 6) AS std_err, n FROM fmt")
def fold_metrics(spark, d):
    return E.fold_metrics(_folded(spark, d)).select("metric", *r6("mean", "std_err"), "n")


@query(_FOLDS + """, m AS (""" + _COUNTS.format("", "scores") + """), b AS (SELECT score, tp / p::DOUBLE AS sens, 1 - fp / n::DOUBLE AS spec, tp / (tp + fp)::DOUBLE AS precision FROM curve ORDER BY tp / p::DOUBLE + (1 - fp / n::DOUBLE) - 1 DESC, score DESC LIMIT 1
), t AS (SELECT metric, 'rank' AS kind, NULL::DOUBLE AS threshold, mean AS value, std_err FROM fmt WHERE metric = 'roc_auc' UNION ALL SELECT 'pr_auc', 'rank', NULL, (""" + _PR + """), NULL
  UNION ALL SELECT h.metric, 'default', 0.5, h.value, f.std_err FROM (SELECT unnest(['sens', 'spec', 'tss', 'precision']) AS metric, unnest([sens, spec, sens + spec - 1, precision]) AS value FROM m) h LEFT JOIN fmt f ON h.metric = f.metric
  UNION ALL SELECT unnest(['sens', 'spec', 'tss', 'precision']), 'best', score, unnest([sens, spec, sens + spec - 1, precision]), NULL FROM b)
SELECT metric, kind, threshold, round(value, 6) AS value, round(std_err, 6) AS std_err FROM t""")
def evaluation_table(spark, d):
    return E.evaluation_table(_folded(spark, d)).select("metric", "kind", "threshold", *r6("value", "std_err"))


# --- surfaces

_WEIGHTS = {"sst": 0.05, "chl": 20.0, "uo": -15.0}
_SHIFTS = (-2.6, -2.3, -2.0, -1.9, -1.5)
_P = "1 / (1 + exp(-({0}::DOUBLE + sst * 0.05::DOUBLE + chl * 20.0::DOUBLE + uo * -15.0::DOUBLE)))"


@query(", s AS (SELECT cell, year, month, list_sort([" + ", ".join(_P.format(x) for x in _SHIFTS) + """]) AS m FROM gappy WHERE chl IS NOT NULL)
SELECT cell, year, month, round(list_stddev_samp(m), 6) AS suitability_sd, round(m[1] + (m[2] - m[1]) * 0.2::DOUBLE, 6) AS suitability_lower, round(m[4] + (m[5] - m[4]) * 0.8::DOUBLE, 6) AS suitability_upper, 5 AS n_members FROM s""")
def ensemble_spread(spark, d):
    g = ST.complete(A.gappy(A.grid(spark, d)), COVARIATES)
    return U.spread(g, [U.logistic(s, _WEIGHTS) for s in _SHIFTS]).select("cell", "year", "month", *r6("suitability_sd", "suitability_lower", "suitability_upper"), "n_members")


@query("SELECT year, month, n_grid, unnest(['sst', 'chl']) AS predictor, unnest([a, b]) AS n_missing FROM (SELECT year, month, count(*) AS n_grid, count(*) - count(sst) AS a, count(*) - count(chl) AS b FROM gappy GROUP BY year, month)")
def coverage_report(spark, d):
    return U.coverage(A.gappy(A.grid(spark, d)), ["sst", "chl"])


@query("SELECT year, month, count(chl) AS n_cells, count(*) AS n_grid FROM gappy GROUP BY year, month ORDER BY count(chl)::DOUBLE / count(*), year, month LIMIT 1")
def worst_month(spark, d):
    return U.worst_month(A.gappy(A.grid(spark, d)), ["sst", "chl"])


def _sim(v: str) -> str:
    return f"""CASE WHEN x.{v} IS NULL THEN NULL WHEN r.hi_{v} = r.lo_{v} THEN CASE WHEN x.{v} = r.lo_{v} THEN 100.0 ELSE -1.0 / 0 END WHEN b_{v} = 0 THEN 100 * ((x.{v} - r.lo_{v}) / (r.hi_{v} - r.lo_{v}))
    WHEN 100.0::DOUBLE * b_{v} / r.n_{v} <= 50 THEN 2 * (100.0::DOUBLE * b_{v} / r.n_{v}) WHEN 100.0::DOUBLE * b_{v} / r.n_{v} < 100 THEN 2 * (100 - 100.0::DOUBLE * b_{v} / r.n_{v}) ELSE 100 * ((r.hi_{v} - x.{v}) / (r.hi_{v} - r.lo_{v})) END"""


_NOVEL = """, tr AS (SELECT sst, chl FROM grid WHERE year <= 1998 AND sst BETWEEN 10 AND 40 AND chl BETWEEN 0.02 AND 0.08), px AS (SELECT cell, year, month, sst, chl FROM gappy WHERE year > 1998
), r AS (SELECT count(sst) AS n_sst, min(sst) AS lo_sst, max(sst) AS hi_sst, count(chl) AS n_chl, min(chl) AS lo_chl, max(chl) AS hi_chl FROM tr
), bs AS (SELECT v, (SELECT count(*) FROM tr WHERE tr.sst < u.v) AS b_sst FROM (SELECT DISTINCT sst AS v FROM px) u), bc AS (SELECT v, (SELECT count(*) FROM tr WHERE tr.chl < u.v) AS b_chl FROM (SELECT DISTINCT chl AS v FROM px WHERE chl IS NOT NULL) u
), sims AS (SELECT x.cell, x.year, x.month, """ + _sim("sst") + " AS s1, " + _sim("chl") + """ AS s2 FROM px x LEFT JOIN bs ON x.sst = bs.v LEFT JOIN bc ON x.chl = bc.v, r
), nov AS (SELECT cell, year, month, CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN least(s1, s2) END AS novelty, CASE WHEN s2 IS NULL OR s1 <= s2 THEN 'sst' ELSE 'chl' END AS novel_variable FROM sims)
"""


def _novelty(spark, d):
    g = A.grid(spark, d)
    train = g.filter("year <= 1998 and sst between 10 and 40 and chl between 0.02 and 0.08")
    return U.novelty(A.gappy(g).filter("year > 1998").select("cell", "year", "month", "sst", "chl"), train, ["sst", "chl"], ["cell", "year", "month"])


@query(_NOVEL + "SELECT cell, year, month, round(novelty, 6) AS novelty, novel_variable FROM nov")
def novelty(spark, d):
    return _novelty(spark, d).select("cell", "year", "month", *r6("novelty"), "novel_variable")


@query(_NOVEL + "SELECT novel_variable, count(*) AS n_outside, round(count(*) / (SELECT count(*) FROM nov)::DOUBLE, 6) AS share FROM nov WHERE novelty < 0 GROUP BY novel_variable")
def novelty_summary(spark, d):
    return U.novelty_summary(_novelty(spark, d)).select("novel_variable", "n_outside", *r6("share"))


@query("""SELECT station_id, round((sst - m1) / s1, 6) AS sst, round((chl - m2) / s2, 6) AS chl FROM matched, (SELECT avg(sst) AS m1, stddev_samp(sst) AS s1, avg(chl) AS m2, stddev_samp(chl) AS s2 FROM matched WHERE station_id % 5 <> 0)""")
def normalize(spark, d):
    m = _matched(spark, d).select("station_id", "sst", "chl")
    return U.normalised(m, ["sst", "chl"], F.col("station_id") % 5 != 0).select("station_id", *r6("sst", "chl"))


_LAYERS = [f"{y}_{m:02d}" for y in range(1992, 1999) for m in range(1, 13)]  # all months that the tables have


@query("SELECT cell, " + ", ".join(f"round(max(CASE WHEN year = {x[:4]} AND month = {int(x[5:])} THEN p END), 6) AS \"{x}\"" for x in _LAYERS) + f" FROM (SELECT *, {_P.format(-2.0)} AS p FROM gappy WHERE chl IS NOT NULL) GROUP BY cell")
def suitability_stack(spark, d):
    g = ST.complete(A.gappy(A.grid(spark, d)), COVARIATES).withColumn("p", F.round(U.logistic(-2.0, _WEIGHTS), 6))
    return U.stack(g, "p", ["cell"], _LAYERS)


@query(""", sample AS (SELECT sst, chl, uo FROM grid), sweep AS (
  SELECT DISTINCT 'sst' AS variable, v AS value FROM (SELECT unnest(quantile_cont(sst, [0, 0.25, 0.5, 0.75, 1])) AS v FROM sample) UNION SELECT DISTINCT 'chl', v FROM (SELECT unnest(quantile_cont(chl, [0, 0.25, 0.5, 0.75, 1])) AS v FROM sample))
SELECT variable, round(value, 6) AS value, round(avg(""" + _P.format(-2.0).replace("sst *", "CASE WHEN variable = 'sst' THEN value ELSE sst END *").replace("chl *", "CASE WHEN variable = 'chl' THEN value ELSE chl END *") + "), 6) AS probability FROM sample, sweep GROUP BY variable, sweep.value")
def partial_dependence(spark, d):
    rows = A.grid(spark, d).select("sst", "chl", "uo")
    swept = U.partial_dependence(rows, ["sst", "chl"], lambda: U.logistic(-2.0, _WEIGHTS), 5, carried=["uo"])
    return swept.select("variable", *r6("value", "probability"))


# --- a configured run up to the model


RUN = {
    "species": {"name": "abundance"},
    "columns": {"dataset_filter": ["1-URGENT", "2-HIGH", "3-MEDIUM"]},
    "dates": {"training": {"years": [1993, 1997], "months": [2, 11]}, "projection": {"years": [1998, 1998], "months": [2, 11]}},
    "study_area": {"xmin": -75.95, "xmax": -73.8, "ymin": 35.05, "ymax": 37.2},
    "covariates": {
        "products": [{"variables": ["sst", "chl"]}, {"variables": ["chl_model"], "resolution": 0.5}], "prejoin": [{"type": "fill_gaps", "covariate": "chl", "from": "chl_model"}],
        "bathymetry": ["depth"], "climate": ["idx"], "steps": [{"type": "lag", "var": "sst"}]},
    "model": {"type": "glm", "folds": 3},
}


def frames(spark, d):
    """The driver's tables in the place of what a run's settings name."""
    from .plans import pipeline as P
    from .plans import products as PR

    g = A.grid(spark, d)
    fine = PR.Product(A.gappy(g).select(*PR.PLACE, "sst", "chl"), ("sst", "chl"), A.LATTICE)
    coarse = PR.Product(A.coarse(g).withColumnRenamed("chl", "chl_model").select(*PR.PLACE, "chl_model"), ("chl_model",), A.COARSE)
    return P.Frames(A.stations(spark, d), [fine, coarse], A.placed(A.static(spark, d)), A.index_series(spark, d))


@query(""", st AS (SELECT cell, depth, -76000000::BIGINT + 250000 * (cell % 10) AS lon_u, 35000000::BIGINT + 250000 * (cell // 10) AS lat_u FROM static
), deep AS (SELECT station_id, depth FROM (SELECT s.station_id, t.depth, row_number() OVER (PARTITION BY s.station_id ORDER BY (s.lon_u - t.lon_u) * (s.lon_u - t.lon_u) + (s.lat_u - t.lat_u) * (s.lat_u - t.lat_u), t.cell) AS r FROM stations s, st t) WHERE r = 1
), lags AS (SELECT cell, year, month, lag(sst) OVER (PARTITION BY cell ORDER BY year, month) AS sst_lag1 FROM grid
), ready AS (SELECT m.station_id, m.cell, m.abundance, m.sst, coalesce(g.chl, c.chl) AS chl, l.sst_lag1, i.idx, d.depth FROM matched m JOIN gappy g ON g.cell = m.cell AND g.year = m.year AND g.month = m.month
  LEFT JOIN coarse c ON c.year = g.year AND c.month = g.month AND c.ix = g.ix // 2 AND c.iy = g.iy // 2 JOIN lags l ON l.cell = m.cell AND l.year = m.year AND l.month = m.month
  LEFT JOIN idx i ON i.year = m.year AND i.month = m.month JOIN deep d ON d.station_id = m.station_id
  WHERE m.year BETWEEN 1993 AND 1997 AND m.month BETWEEN 2 AND 11 AND m.lon_u / 1e6 BETWEEN -75.95 AND -73.8 AND m.lat_u / 1e6 BETWEEN 35.05 AND 37.2 AND dataset IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
    AND l.sst_lag1 IS NOT NULL AND coalesce(g.chl, c.chl) IS NOT NULL AND d.depth IS NOT NULL
), cut AS (SELECT CASE WHEN q < 1500 THEN q ELSE round_even(q / 1000, 0) * 1000 END AS threshold FROM (SELECT quantile_cont(abundance, 0.9) AS q FROM ready))
SELECT station_id, cell, round(sst, 6) AS sst, round(chl, 9) AS chl, round(sst_lag1, 6) AS sst_lag1, round(idx, 6) AS idx, round(depth, 6) AS depth, CASE WHEN abundance >= threshold THEN 'patch' ELSE 'non_patch' END AS patch FROM ready, cut""")
def config_run(spark, d):
    from .plans import config as C
    from .plans import pipeline as P

    ready = P.prepare(spark, C.resolve({**RUN, "species": {**RUN["species"], "min_rows": 1}}), frames(spark, d))
    return ready.data.select("station_id", "cell", *r6("sst"), *r6("chl", digits=9), *r6("sst_lag1", "idx", "depth"), "patch")


@query("""SELECT f.cell, f.year, f.month, round(sum(v / greatest(d, 1e-12)) / sum(1 / greatest(d, 1e-12)), 6) AS chl FROM (SELECT f.cell, f.year, f.month, c.chl AS v, d, row_number() OVER (PARTITION BY f.cell, f.year, f.month ORDER BY d, c.lon_u, c.lat_u) AS r FROM grid f
  JOIN coarse c ON c.year = f.year AND c.month = f.month, LATERAL (SELECT (pow(f.lon_u - c.lon_u, 2) + pow(f.lat_u - c.lat_u, 2)) / 1e12 AS d)) f WHERE r <= 4 GROUP BY f.cell, f.year, f.month""")
def downscale_idw(spark, d):
    g = A.grid(spark, d)
    return G.downscaled_idw(g, A.coarse(g), "chl").select("cell", "year", "month", *r6("chl"))


@query("SELECT bin, n, round(exp(bin * (t / 40)) - 1, 6) AS low, round(exp((bin + 1) * (t / 40)) - 1, 6) AS high FROM (SELECT least(floor(ln(1 + abundance) / (t / 40)), 39)::INTEGER AS bin, t, count(*) AS n FROM stations, (SELECT max(ln(1 + abundance)) AS t FROM stations) GROUP BY 1, 2)")
def histogram(spark, d):
    return ST.histogram(A.stations(spark, d)).select("bin", "n", *r6("low", "high"))


@query("""SELECT cell, year, month, round(CASE WHEN s1 > 0 THEN (coarse_chl - m1) / s1 * s2 + m2 ELSE coarse_chl END, 9) AS chl FROM (SELECT f.cell, f.year, f.month, c.chl AS coarse_chl FROM gappy f JOIN coarse c ON f.year = c.year AND f.month = c.month AND c.ix = f.ix // 2 AND c.iy = f.iy // 2),
(SELECT avg(c.chl) AS m1, stddev_samp(c.chl) AS s1, avg(f.chl) AS m2, stddev_samp(f.chl) AS s2 FROM gappy f JOIN coarse c ON f.year = c.year AND f.month = c.month AND c.ix = f.ix // 2 AND c.iy = f.iy // 2 WHERE f.chl IS NOT NULL AND c.chl IS NOT NULL)""")
def rescaled_gap_source(spark, d):
    g = A.grid(spark, d)
    fine = A.gappy(g).select(F.col("cell").alias("fine"), "year", "month", "lon_u", "lat_u", "chl")
    both = M.nearest(fine, ["fine", "year", "month"], A.coarse(g).withColumnRenamed("chl", "model_chl"), ["model_chl"], A.COARSE, left=True)
    return M.rescaled(both, "model_chl", "chl").select(F.col("fine").alias("cell"), "year", "month", F.round("model_chl", 9).alias("chl"))


@query("""SELECT cell, year, month, round((sst - lag(sst) OVER w) / date_diff('day', lag(make_date(year, month, 1)) OVER w, make_date(year, month, 1)), 7) AS per_day, round(sst - lag(sst) OVER w, 6) AS per_step FROM grid WINDOW w AS (PARTITION BY cell ORDER BY year, month)""")
def temporal_gradient_per(spark, d):
    g = G.temporal_gradient(G.temporal_gradient(A.grid(spark, d), "sst", "per_day", "day"), "sst", "per_step", "step")
    return g.select("cell", "year", "month", *r6("per_day", digits=7), *r6("per_step"))


def _moment(x: str, lam: float, kind: str) -> str:
    if kind == "boxcox":
        return f"ln({x})" if lam == 0 else f"(pow({x}, {lam}::DOUBLE) - 1) / {lam}::DOUBLE"
    up = f"ln(1 + {x})" if lam == 0 else f"(pow({x} + 1, {lam}::DOUBLE) - 1) / {lam}::DOUBLE"
    down = f"-ln(1 - {x})" if lam == 2 else f"-(pow(1 - {x}, {2 - lam}::DOUBLE) - 1) / {2 - lam}::DOUBLE"
    return f"CASE WHEN {x} >= 0 THEN {up} ELSE {down} END"


def _profile(x: str, table: str, kind: str) -> str:
    from .plans.models import LAMBDAS

    jac = f"ln({x})" if kind == "boxcox" else f"sign({x}) * ln(1 + abs({x}))"
    rows = " UNION ALL ".join(f"SELECT {lam}::DOUBLE AS lam, round(-count(*) / 2.0::DOUBLE * ln(var_pop({_moment(x, lam, kind)})) + ({lam} - 1) * sum({jac}), 3) AS log_likelihood FROM {table} WHERE {x} IS NOT NULL" for lam in LAMBDAS)
    return f"SELECT * FROM ({rows})"


@query(_profile("abundance", "stations", "boxcox"))
def boxcox(spark, d):
    from .plans import models as MD

    return MD.power_profile(A.stations(spark, d), "abundance", "boxcox").select("lam", *r6("log_likelihood", digits=3))


@query(_profile("uo", "grid", "yeojohnson"))
def yeojohnson(spark, d):
    from .plans import models as MD

    return MD.power_profile(A.grid(spark, d), "uo", "yeojohnson").select("lam", *r6("log_likelihood", digits=3))


@query("""SELECT variable, count(*) AS n_cells, count(*) FILTER (v IS NULL) AS n_missing FROM (SELECT unnest(['sst', 'chl', 'uo']) AS variable, unnest([sst, chl, uo]) AS v FROM gappy WHERE year = 1995 AND month = 6) GROUP BY variable""")
def slice_missing(spark, d):
    return G.missing_counts(G.month_slice(A.gappy(A.grid(spark, d)), 1995, 6), ["sst", "chl", "uo"]).select("variable", "n_cells", "n_missing")


@query("SELECT cell, year, month, round(sst, 6) AS sst, round(ln(chl), 6) AS l FROM grid WHERE chl > 0 AND sst IS NOT NULL")
def finite_cases(spark, d):
    logs = A.grid(spark, d).withColumn("l", F.when(F.col("chl") > 0, F.ln("chl")).otherwise(float("-inf")))
    return ST.complete(logs, ["sst", "l"]).select("cell", "year", "month", *r6("sst", "l"))


@query("SELECT year, month, round(quantile_cont(sst, 0.3), 6) AS percentile FROM grid GROUP BY year, month")
def step_percentiles(spark, d):
    return G.step_percentiles(A.grid(spark, d), "sst", 0.3).select("year", "month", *r6("percentile"))


# --- models and numerical kernels: rows only, no SQL form


def _training(spark, d) -> DataFrame:
    m = ST.complete(_matched(spark, d).select("station_id", "month", "abundance", *COVARIATES), COVARIATES)
    return m.withColumn("label", (F.col("sst") + 40 * F.col("chl") + F.pmod(F.xxhash64("station_id"), F.lit(7)) > 31).cast("int")).persist()


def _fitted(spark, d, **settings):
    from .plans import models as MD

    t = _training(spark, d)
    return MD.fit(t, ["sst", "chl", "uo"], MD.Spec(**settings)), t


@query()
def fit_glm(spark, d):
    from .plans import models as MD

    return MD.coefficients(_fitted(spark, d, type="glm")[0])


@query()
def fit_cauchit(spark, d):
    from .plans import models as MD

    return MD.coefficients(_fitted(spark, d, type="glm", link="cauchit")[0])


@query()
def fit_log_link(spark, d):
    from .plans import models as MD

    return MD.coefficients(_fitted(spark, d, type="glm", link="log")[0])


@query()
def fit_rf(spark, d):
    m, t = _fitted(spark, d, type="rf")
    return E.roc_auc(m.score(t))


@query()
def fit_brt(spark, d):
    m, t = _fitted(spark, d, type="brt", trees=8, depth=4, rate=0.2)
    return E.roc_auc(m.score(t))


@query()
def fit_gam(spark, d):
    m, t = _fitted(spark, d, type="gam")
    return E.roc_auc(m.score(t))


@query()
def importance(spark, d):
    from .plans import models as MD

    m, t = _fitted(spark, d, type="rf")
    return MD.importance(m, t)


@query()
def bootstrap_evaluation(spark, d):
    from .plans import models as MD

    return MD.bootstrap(A.scores(spark, d), 0.5)


@query()
def smooth_terms(spark, d):
    from .plans import models as MD

    return MD.smooth_terms(_fitted(spark, d, type="gam")[0])


@query()
def smooth_terms_reml(spark, d):
    from .plans import models as MD

    return MD.smooth_terms(_fitted(spark, d, type="gam", method="REML", shrink=True, bs={"sst": "cr", "chl": "ps", "uo": "ts"})[0])


@query()
def partial_effects(spark, d):
    from .plans import models as MD

    m, t = _fitted(spark, d, type="rf")
    return MD.partial_effects(m, t)


@query()
def project_months(spark, d):
    from .plans import models as MD

    m, t = _fitted(spark, d, type="rf")
    return MD.projected(m, A.grid(spark, d), None, t)


@query()
def ftle(spark, d):
    from .operators import lyapunov as L

    return L.ftle(A.grid(spark, d), "uo", "vo", A.CELL)


@query()
def fsle(spark, d):
    from .operators import lyapunov as L

    return L.fsle(A.grid(spark, d), "uo", "vo", A.CELL)


@query()
def pipeline_run(spark, d):
    """A whole configured run over the given tables: several products, layers, a fitted power, an additive model, bounds."""
    from .plans import config as C
    from .plans import pipeline as P

    window = {"years": [1992, 1998], "months": [1, 12]}
    settings = {
        **RUN, "dates": {"training": window, "projection": window}, "columns": {"dataset_filter": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}, "study_area": {"xmin": -76.0, "xmax": -73.7, "ymin": 35.0, "ymax": 37.3},
        "covariates": {**RUN["covariates"], "transforms": {"sst": "yeojohnson"}}, "model": {"type": "gam", "folds": 3, "method": "REML", "bootstrap": 200, "importance": 1}}
    return P.run(spark, C.resolve(settings), frames=frames(spark, d)).evaluation


#: Settings of a run over made-up data.
MOCK = {
    "species": {"name": "cfin_total"},
    "dates": {"training": {"years": [2018, 2019], "months": [6, 8]}, "projection": {"years": [2019, 2019], "months": [6, 8]}},
    "study_area": {"xmin": -70.0, "xmax": -66.0, "ymin": 41.0, "ymax": 44.0},
    "covariates": {"variables": ["SST", "SSS"]},
    "model": {"type": "glm", "folds": 3},
}
