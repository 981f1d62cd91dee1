"""The archive's queries over the star schema, each next to the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import detectors, scalars, text
from ..functions.unitprice import round6, with_product_key, with_quoted, with_resolved
from ..operators import audit, digest, history, matching, personal, pricecheck, trend
from ..sources import sinks
from ..sources.tables import observations, table, worded_offers
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SANE = 100000.0

OBS = """obs AS (SELECT l_orderkey, l_linenumber, l_suppkey AS supp, l_quantity AS qty, p_partkey AS part, p_name AS title, p_type AS cat, p_brand AS brand,
 CAST(date_trunc('week', l_shipdate) AS DATE) AS d, l_extendedprice AS face,
 floor(l_extendedprice*(1-l_discount)/l_quantity*100+0.5)/100 AS gp, CASE WHEN p_size % 2 = 0 THEN 'kg' ELSE 'l' END AS unit,
 'w' || CAST(CAST(floor(log10(l_quantity)) AS INT) AS VARCHAR) AS bucket,
 CAST(p_partkey AS VARCHAR) || '|' || (CASE WHEN p_size % 2 = 0 THEN 'kg' ELSE 'l' END) || '|w' || CAST(CAST(floor(log10(l_quantity)) AS INT) AS VARCHAR) AS key,
 CASE WHEN l_returnflag = 'N' THEN 'range' END AS gpf, (l_linestatus = 'F' AND l_discount >= 0.05) AS flagged, l_tax >= 0.05 AS bonus
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""
WEEKLY = OBS + ", weekly AS (SELECT key, d, min(gp) AS gp FROM obs WHERE gpf IS NULL GROUP BY key, d)"
STATS = WEEKLY + ", stats AS (SELECT key, count(*) AS weeks, min(gp) AS low, max(gp) AS high, median(gp) AS med, arg_max(gp, d) AS latest, max(d) AS latest_d FROM weekly GROUP BY key)"
RADAR = STATS + ", radar AS (SELECT key, weeks, low, med, latest, CASE WHEN low > 0 THEN latest/low - 1 ELSE 0 END AS over FROM stats WHERE weeks >= 3 AND latest_d = (SELECT max(d) FROM obs))"
INDEXED = WEEKLY + ", i AS (SELECT key, d, gp, row_number() OVER (PARTITION BY key ORDER BY d) AS rn, count(*) OVER (PARTITION BY key) AS n, min(gp) OVER (PARTITION BY key) AS low FROM weekly)"
R6 = "floor(({})*1e6+0.5)/1e6"


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _weekly(spark, sf):
    return history.weekly_exact(observations(spark, sf))


def _latest(spark, sf):
    """The newest week, from the offers' dates alone."""
    return F.broadcast(table(spark, sf, "lineitem").agg(F.date_trunc("week", F.max("l_shipdate")).cast("date").alias("top")))


def _radar(spark, sf):
    stats = history.product_stats(_weekly(spark, sf)).where("weeks >= 3").join(_latest(spark, sf), F.col("latest_d") == F.col("top"))
    return stats.select("key", "weeks", "low", "med", "latest", F.when(F.col("low") > 0, F.col("latest") / F.col("low") - 1).otherwise(0.0).alias("over"))


for _name, _dir in (("q01_deal_radar_lows", "ASC"), ("q02_deal_radar_highs", "DESC")):

    @query(_name, f"WITH {RADAR} SELECT key, weeks, low, med, latest, {R6.format('over')} AS over FROM radar ORDER BY radar.over {_dir}, key LIMIT 8")
    def _(spark, sf, up=_dir == "ASC"):
        by = F.col("over").asc() if up else F.col("over").desc()
        return _radar(spark, sf).orderBy(by, "key").limit(8).withColumn("over", round6(F.col("over")))


@query("q03_weekly_category_counts", f"WITH {OBS} SELECT d, cat, count(*) AS n FROM obs GROUP BY d, cat")
def _(spark, sf):
    return trend.category_counts(observations(spark, sf))


@query("q04_weekly_trend_kpis", f"""WITH {OBS} SELECT d, count(*) AS total, count(*) FILTER (flagged) AS flagged, count(*) FILTER (bonus) AS bonus,
 {R6.format("count(*) FILTER (gpf IS NULL) / count(*)::DOUBLE")} AS coverage, {R6.format(f"avg(face) FILTER (face BETWEEN 0 AND {SANE})")} AS avg_face,
 median(face) FILTER (face BETWEEN 0 AND {SANE}) AS med_face FROM obs GROUP BY d""")  # fmt: skip
def _(spark, sf):
    return trend.week_figures(observations(spark, sf), SANE)


@query("q05_product_observations", f"""WITH {OBS} SELECT key, arg_max(title, (d, l_orderkey, l_linenumber)) AS title, count(DISTINCT d) AS weeks, count(*) AS n_obs
 FROM obs GROUP BY key HAVING count(DISTINCT d) >= 2""")  # fmt: skip
def _(spark, sf):
    return history.gathered(observations(spark, sf)).select("key", "title", "weeks", F.size("obs").cast("long").alias("n_obs"))


@query("q06_weekly_exact_min", f"WITH {WEEKLY} SELECT * FROM weekly")
def _(spark, sf):
    return _weekly(spark, sf)


@query("q07_product_stats", f"WITH {STATS} SELECT * FROM stats")
def _(spark, sf):
    return history.product_stats(_weekly(spark, sf))


@query("q08_drought", f"""WITH {INDEXED}, s AS (SELECT key, max(n) AS weeks, max(n) - max(CASE WHEN gp <= low + 1e-9 THEN rn END) AS since_low, arg_max(gp, d) AS latest, max(low) AS low FROM i GROUP BY key)
 SELECT key, weeks, since_low, {R6.format("CASE WHEN low > 0 THEN latest/low - 1 ELSE 0 END")} AS over FROM s WHERE weeks >= 4 AND since_low >= 1
 ORDER BY since_low DESC, (CASE WHEN low > 0 THEN latest/low - 1 ELSE 0 END) DESC, key LIMIT 10""")  # fmt: skip
def _(spark, sf):
    over = F.when(F.col("low") > 0, F.col("latest") / F.col("low") - 1).otherwise(0.0)
    s = history.weeks_since_low(_weekly(spark, sf)).where("weeks >= 4 and since_low >= 1").withColumn("over", over)
    return s.orderBy(F.desc("since_low"), F.desc("over"), "key").limit(10).select("key", "weeks", "since_low", round6(F.col("over")).alias("over"))


@query("q09_half_split_erosion", f"""WITH {INDEXED}, e AS (SELECT key, max(n) AS weeks, median(gp) FILTER (rn <= n // 2) AS first_med, median(gp) FILTER (rn > n - n // 2) AS last_med FROM i WHERE n >= 4 GROUP BY key)
 SELECT key, weeks, first_med, last_med, {R6.format("last_med/first_med - 1")} AS erosion FROM e WHERE first_med > 0""")  # fmt: skip
def _(spark, sf):
    return history.erosion(_weekly(spark, sf))


VARIATION = INDEXED + f", v AS (SELECT key, max(n) AS weeks, {R6.format('stddev_pop(gp)/avg(gp)')} AS cv, {R6.format('regr_slope(gp, rn-1)/avg(gp)')} AS slope FROM i WHERE n >= 4 GROUP BY key HAVING avg(gp) > 0)"
for _name, _by, _dir in (("q10_volatility_high", "cv", "DESC"), ("q11_volatility_low", "cv", "ASC"), ("q12_slope_up", "slope", "DESC"), ("q13_slope_down", "slope", "ASC")):

    @query(_name, f"WITH {VARIATION} SELECT key, weeks, cv, slope FROM v ORDER BY {_by} {_dir}, key LIMIT 10")
    def _(spark, sf, by=_by, down=_dir == "DESC"):
        return history.variation(_weekly(spark, sf)).orderBy(F.desc(by) if down else F.asc(by), "key").limit(10)


FACE = f"face) FILTER (face BETWEEN 0 AND {SANE}"


@query("q14_category_share", f"WITH {OBS} SELECT cat, count(*) AS n, {R6.format(f'coalesce(avg({FACE}), 0)')} AS mean FROM obs GROUP BY cat")
def _(spark, sf):
    return trend.category_prices(observations(spark, sf), SANE).select("cat", "n", "mean")


@query("q15_category_price_distribution", f"WITH {OBS} SELECT cat, min({FACE}) AS low, median({FACE}) AS med, max({FACE}) AS high, max({FACE}) - min({FACE}) AS span FROM obs GROUP BY cat")
def _(spark, sf):
    return trend.category_prices(observations(spark, sf), SANE).select("cat", "low", "med", "high", "span")


@query("q16_category_delta", f"""WITH {OBS}, c AS (SELECT d, cat, count(*) AS n FROM obs GROUP BY d, cat), w AS (SELECT DISTINCT d FROM c ORDER BY d DESC LIMIT 2)
 SELECT cat, CAST(sum(CASE WHEN d = (SELECT max(d) FROM w) THEN n ELSE 0 END) AS BIGINT) AS now, CAST(sum(CASE WHEN d < (SELECT max(d) FROM w) THEN n ELSE 0 END) AS BIGINT) AS before,
 CAST(sum(CASE WHEN d = (SELECT max(d) FROM w) THEN n ELSE -n END) AS BIGINT) AS delta FROM c WHERE d IN (SELECT d FROM w) GROUP BY cat""")  # fmt: skip
def _(spark, sf):
    return trend.delta_to_previous(trend.category_counts(observations(spark, sf)))


@query("q17_month_category_seasonality", f"""WITH {OBS}, c AS (SELECT d, cat, count(*) AS n FROM obs GROUP BY d, cat), w AS (SELECT month(d) AS month, count(DISTINCT d) AS weeks FROM c GROUP BY 1),
 s AS (SELECT month(d) AS month, cat, sum(n) AS n FROM c GROUP BY 1, 2)
 SELECT CAST(w.month AS INT) AS month, k.cat, {R6.format("coalesce(s.n, 0) / w.weeks::DOUBLE")} AS mean FROM w CROSS JOIN (SELECT DISTINCT cat FROM c) k LEFT JOIN s ON s.month = w.month AND s.cat = k.cat""")  # fmt: skip
def _(spark, sf):
    return trend.seasonality(trend.category_counts(observations(spark, sf)))


HONEST = STATS + """, k AS (SELECT key, min(gp) AS kmin FROM obs WHERE flagged AND gpf IS NULL GROUP BY key),
 h AS (SELECT key, weeks, med, kmin, kmin/med AS ratio FROM k JOIN stats USING (key) WHERE weeks >= 3 AND med > 0)"""


def _honest(spark, sf):
    obs = observations(spark, sf)
    k = obs.where("flagged and gpf is null").groupBy("key").agg(F.min("gp").alias("kmin"))
    stats = history.product_stats(history.weekly_exact(obs)).where("weeks >= 3 and med > 0")
    return k.join(stats, "key").select("key", "weeks", "med", "kmin", (F.col("kmin") / F.col("med")).alias("ratio"))


for _name, _where, _dir in (("q18_flag_honesty_good", "ratio <= 0.95", "ASC"), ("q19_flag_honesty_bad", "ratio >= 1.0", "DESC")):

    @query(_name, f"WITH {HONEST} SELECT key, weeks, med, kmin, {R6.format('h.ratio')} AS ratio FROM h WHERE h.{_where} ORDER BY h.ratio {_dir}, key LIMIT 10")
    def _(spark, sf, where=_where, up=_dir == "ASC"):
        by = F.asc("ratio") if up else F.desc("ratio")
        return _honest(spark, sf).where(where).orderBy(by, "key").limit(10).withColumn("ratio", round6(F.col("ratio")))


@query("q20_flag_honesty_balanced", f"""WITH {HONEST}, r AS (SELECT *, row_number() OVER (ORDER BY ratio, key) AS a, row_number() OVER (ORDER BY ratio DESC, key) AS b FROM h)
 SELECT key, {R6.format("r.ratio")} AS ratio, floor((ratio - 1)*1000 + 0.5)/10 AS deviation FROM r WHERE a <= 12 OR b <= 12""")  # fmt: skip
def _(spark, sf):
    h = _honest(spark, sf)
    low, high = h.orderBy("ratio", "key").limit(12), h.orderBy(F.desc("ratio"), "key").limit(12)  # two top-k instead of a global window
    return low.unionByName(high).dropDuplicates(["key"]).select("key", round6(F.col("ratio")).alias("ratio"), (F.floor((F.col("ratio") - 1) * 1000 + 0.5) / 10).alias("deviation"))


@query("q21_league_per_unit", f"""WITH {OBS}, c AS (SELECT key, unit, min(gp) AS cur FROM obs WHERE gpf IS NULL AND d = (SELECT max(d) FROM obs) GROUP BY key, unit),
 r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY cur, key) AS place FROM c) SELECT unit, place, key, cur FROM r WHERE place <= 10""")  # fmt: skip
def _(spark, sf):
    cur = observations(spark, sf).where("gpf is null").join(_latest(spark, sf), F.col("d") == F.col("top")).groupBy("key", "unit").agg(F.min("gp").alias("cur"))
    place = F.row_number().over(Window.partitionBy("unit").orderBy("cur", "key")).cast("long")
    return cur.withColumn("place", place).where("place <= 10").select("unit", "place", "key", "cur")


for _name, _dir in (("q22_top5_cheapest", "ASC"), ("q23_top5_expensive", "DESC")):

    @query(_name, f"WITH {OBS} SELECT l_orderkey, l_linenumber, part, supp, face, d FROM obs WHERE face BETWEEN 0 AND {SANE} ORDER BY face {_dir}, l_orderkey, l_linenumber, part, supp, d LIMIT 5")
    def _(spark, sf, up=_dir == "ASC"):
        o = observations(spark, sf).where(F.col("face").between(0, SANE))
        return o.orderBy(F.asc("face") if up else F.desc("face"), "l_orderkey", "l_linenumber", "part", "supp", "d").limit(5).select("l_orderkey", "l_linenumber", "part", "supp", "face", "d")


PRIOR = WEEKLY + ", p AS (SELECT *, min(gp) OVER b AS prior_low, count(*) OVER b AS prior FROM weekly WINDOW b AS (PARTITION BY key ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
OVER = "CASE WHEN prior_low > 0 THEN CAST(floor((gp/prior_low - 1)*100 + 0.5) AS BIGINT) ELSE 0 END"


@query("q24_price_check_tier", f"""WITH {PRIOR}, o AS (SELECT *, {OVER} AS over_pct FROM p WHERE prior >= 2) SELECT key, d, gp, prior_low, prior, over_pct,
 CASE WHEN gp <= prior_low + 1e-9 THEN 'best' WHEN over_pct <= 10 THEN 'good' WHEN over_pct >= 20 THEN 'wait' END AS tier FROM o""")  # fmt: skip
def _(spark, sf):
    return pricecheck.tiers(_weekly(spark, sf))


@query("q25_best_price_run_length", f"""WITH {INDEXED} SELECT a.key, a.d, a.gp, a.rn - 1 - coalesce(max(b.rn), 0) AS run FROM i a LEFT JOIN i b ON a.key = b.key AND b.rn < a.rn AND b.gp <= a.gp + 1e-9 GROUP BY a.key, a.d, a.gp, a.rn""")
def _(spark, sf):
    return pricecheck.run_length(_weekly(spark, sf))


PCT = INDEXED + ", q AS (SELECT a.key, a.d, a.gp, a.n, a.rn - 1 AS prior, count(b.gp) AS cheaper FROM i a LEFT JOIN i b ON a.key = b.key AND b.rn < a.rn AND b.gp < a.gp GROUP BY ALL)"


@query("q26_percentile_prior", f"WITH {PCT} SELECT key, d, cheaper, prior, CAST(floor(cheaper*100/prior::DOUBLE + 0.5) AS BIGINT) AS pctile FROM q WHERE prior >= 1")
def _(spark, sf):
    return pricecheck.percentile_prior(_weekly(spark, sf))


@query("q27_percentile_full", f"WITH {INDEXED}, f AS (SELECT key, d, n, percent_rank() OVER (PARTITION BY key ORDER BY gp) AS r FROM i) SELECT key, d, {R6.format('r')} AS pctile FROM f WHERE n >= 4")
def _(spark, sf):
    return pricecheck.percentile_full(_weekly(spark, sf)).select("key", "d", round6(F.col("full")).alias("pctile"))


@query("q28_price_evidence", f"""WITH {PRIOR}, c AS (SELECT a.key, a.d, count(b.gp) AS cheaper FROM weekly a LEFT JOIN weekly b ON a.key = b.key AND b.d < a.d AND b.gp < a.gp GROUP BY ALL)
 SELECT key, d, gp <= prior_low + 1e-9 AS best, greatest(0, {OVER}) AS over_pct, CAST(floor(cheaper*100/prior::DOUBLE + 0.5) AS BIGINT) AS pctile, prior AS weeks FROM p JOIN c USING (key, d) WHERE prior >= 2""")  # fmt: skip
def _(spark, sf):
    return pricecheck.evidence(_weekly(spark, sf))


DIGEST = STATS + ", dg AS (SELECT * FROM stats WHERE weeks >= 3 AND latest_d = (SELECT max(d) FROM obs))"


def _digest(spark, sf):
    return history.product_stats(_weekly(spark, sf)).where("weeks >= 3").join(_latest(spark, sf), F.col("latest_d") == F.col("top"))


@query("q29_insights_pricier", f"""WITH {DIGEST} SELECT key, latest AS current_gp, low AS hist_min_gp, floor((latest/low - 1)*1000 + 0.5)/10 AS pct_above_min FROM dg
 WHERE low > 0 AND latest > low AND (latest/low - 1)*100 >= 5 ORDER BY pct_above_min DESC, key LIMIT 15""")  # fmt: skip
def _(spark, sf):
    g = _digest(spark, sf).where("low > 0 and latest > low and (latest/low - 1)*100 >= 5")
    g = g.select("key", F.col("latest").alias("current_gp"), F.col("low").alias("hist_min_gp"), (F.floor((F.col("latest") / F.col("low") - 1) * 1000 + 0.5) / 10).alias("pct_above_min"))
    return g.orderBy(F.desc("pct_above_min"), "key").limit(15)


@query("q30_insights_deals", f"""WITH {DIGEST} SELECT key, latest AS current_gp, high AS hist_max_gp, floor((1 - latest/high)*1000 + 0.5)/10 AS drop_vs_max_pct FROM dg
 WHERE latest <= low*1.001 AND high > low ORDER BY drop_vs_max_pct DESC, key LIMIT 15""")  # fmt: skip
def _(spark, sf):
    g = _digest(spark, sf).where("latest <= low*1.001D and high > low")
    g = g.select("key", F.col("latest").alias("current_gp"), F.col("high").alias("hist_max_gp"), (F.floor((1 - F.col("latest") / F.col("high")) * 1000 + 0.5) / 10).alias("drop_vs_max_pct"))
    return g.orderBy(F.desc("drop_vs_max_pct"), "key").limit(15)


TXT = "CAST(CAST(gp AS DECIMAL(12,2)) AS VARCHAR)"
WORDED = OBS + f""", worded AS (SELECT *, CASE l_linenumber % 6 WHEN 0 THEN 'je ' || CAST(qty AS INT) || ' g Packung (1 kg = € ' || {TXT} || ')' WHEN 1 THEN '1 kg = ab € ' || {TXT}
 WHEN 2 THEN '1 l = € ' || {TXT} || ' / € ' || CAST(CAST(gp + 1 AS DECIMAL(12,2)) AS VARCHAR) WHEN 3 THEN 'je ' || CAST(qty AS INT) || ' ml Flasche'
 WHEN 4 THEN '6 x ' || CAST(qty AS INT) || ' g' ELSE CAST(qty AS INT) || ' Stück Packung' END AS wording FROM obs)"""
ROW = "l_orderkey, l_linenumber, part, supp, d"
ROWS = ["l_orderkey", "l_linenumber", "part", "supp", "d"]
DEC = "CAST({} AS DECIMAL(12,2))::DOUBLE"


@query("q31_parse_quoted_unit_price", f"""WITH {WORDED} SELECT {ROW}, {DEC.format("gp")} AS value, CASE l_linenumber % 6 WHEN 2 THEN 'l' ELSE 'kg' END AS unit,
 CASE l_linenumber % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'lower' ELSE 'range' END AS flag, {DEC.format("gp")} AS low FROM worded WHERE regexp_matches(wording, '1\\s*[A-Za-z]{{1,3}}\\s*=\\s*(ab\\s*)?€')""")  # fmt: skip
def _(spark, sf):
    q = with_quoted(worded_offers(spark, sf), F.col("wording"), "q").where("q is not null")
    return q.select(*ROWS, "q.value", "q.unit", "q.flag", "q.low")


@query("q32_derive_unit_price", f"""WITH {WORDED} SELECT {ROW}, floor(face / CASE l_linenumber % 6 WHEN 5 THEN qty WHEN 3 THEN qty*0.001 ELSE 1 END * 100 + 0.5)/100 AS value,
 CASE l_linenumber % 6 WHEN 1 THEN 'kg' WHEN 5 THEN 'St' ELSE 'l' END AS unit, 'derived' AS flag FROM worded WHERE l_linenumber % 6 NOT IN (0, 4)""")  # fmt: skip
def _(spark, sf):
    """Every derived price: form 0 names two sizes and form 4 is a multipack, which have none."""
    none = F.lit(None).cast("string")
    r = with_resolved(worded_offers(spark, sf), none, F.col("wording"), none, F.col("face"), "r").where("r.flag = 'derived'")
    return r.select(*ROWS, "r.value", "r.unit", "r.flag")


@query("q33_size_bucket_and_key", f"""WITH {WORDED}, s AS (SELECT *, CASE l_linenumber % 6 WHEN 2 THEN 'v' WHEN 3 THEN 'v' WHEN 5 THEN 'c' ELSE 'w' END AS kind,
 CASE l_linenumber % 6 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 5 THEN qty ELSE qty*0.001 END AS base FROM worded)
 SELECT {ROW}, kind || CAST(CAST(floor(log10(base)) AS INT) AS VARCHAR) AS size_bucket, lower(trim(title)) || '|' || unit || '|' || kind || CAST(CAST(floor(log10(base)) AS INT) AS VARCHAR) AS product_key FROM s""")  # fmt: skip
def _(spark, sf):
    """Bucket and key of every offer, whatever the form of its wording."""
    w = with_product_key(worded_offers(spark, sf), F.col("title"), F.col("unit"), F.col("wording"), "product_key")
    return w.select(*ROWS, F.substring_index("product_key", "|", -1).alias("size_bucket"), "product_key")


@query("q34_price_contradictions", f"""WITH {WORDED}, c AS (SELECT *, {DEC.format("gp")} AS quoted_value, floor(face/(qty*0.001)*100 + 0.5)/100 AS derived_value FROM worded WHERE l_linenumber % 6 = 0)
 SELECT {ROW}, quoted_value, derived_value FROM c WHERE quoted_value > 0 AND (derived_value/quoted_value > 3 OR derived_value/quoted_value < 1/3.0::DOUBLE)""")  # fmt: skip
def _(spark, sf):
    c = audit.contradictions(worded_offers(spark, sf), "wording", "face")
    return c.select(*ROWS, F.col("q.value").alias("quoted_value"), F.col("dv.value").alias("derived_value"))


NT = "regexp_replace(lower(trim({})), '\\s+', ' ', 'g')"
CK = "regexp_replace(" + NT + ", '[^a-z0-9äöüß]', '', 'g')"
TK = "array_to_string(list_sort(list_filter(regexp_split_to_array(replace(" + NT + ", '-', ''), '[^a-z0-9äöüß]+'), lambda w: w <> '')), ' ')"


@query("q35_title_match_three_way", f"""WITH t AS (SELECT DISTINCT p_name AS title FROM part), w AS (SELECT DISTINCT list_aggregate(list_reverse(string_split(p_name, ' ')), 'string_agg', '-') AS title FROM part UNION SELECT replace(p_name, ' ', '') FROM part),
 h AS (SELECT w.title, t.title AS key, 0 AS how FROM w JOIN t ON {NT.format("w.title")} = {NT.format("t.title")} UNION ALL SELECT w.title, t.title, 1 FROM w JOIN t ON {CK.format("w.title")} = {CK.format("t.title")}
 UNION ALL SELECT w.title, t.title, 2 FROM w JOIN t ON {TK.format("w.title")} = {TK.format("t.title")}) SELECT title, key, min(how) AS how FROM h GROUP BY title, key""")  # fmt: skip
def _(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("title")).distinct()
    turned = names.select(F.array_join(F.reverse(F.split("title", " ")), "-").alias("title")).union(names.select(F.replace("title", F.lit(" "), F.lit("")))).distinct()
    return matching.tolerant_matches(turned, names.select("title", F.col("title").alias("key")))


@query("q36_history_only_titles", f"""WITH {OBS}, n AS (SELECT part, arg_max(gp, (d, l_orderkey, l_linenumber)) AS newest, max(d) AS last_d FROM obs GROUP BY part) SELECT part, newest, last_d FROM n
 WHERE part NOT IN (SELECT part FROM obs WHERE d >= (SELECT max(d) FROM obs) - INTERVAL 28 DAY)""")  # fmt: skip
def _(spark, sf):
    o = observations(spark, sf)
    now = o.join(_latest(spark, sf), F.col("d") >= F.date_sub("top", 28)).select("part").distinct()
    newest = o.groupBy("part").agg(F.max_by("gp", F.struct("d", "l_orderkey", "l_linenumber")).alias("newest"), F.max("d").alias("last_d"))
    return newest.join(now, "part", "left_anti")


for _name, _how, _in in (("q37_semi_verbatim", "left_semi", "IN"), ("q38_anti_dropped", "left_anti", "NOT IN")):

    @query(_name, f"SELECT c_custkey, c_name FROM customer WHERE c_custkey {_in} (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
    def _(spark, sf, how=_how):
        urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
        return table(spark, sf, "customer").join(urgent, "c_custkey", how).select("c_custkey", "c_name")


@query("q39_set_operations", """WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
 SELECT 'except' AS op, k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'reverse', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a)
 UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'union', k FROM (SELECT k FROM a UNION SELECT k FROM b)""")  # fmt: skip
def _(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    named = {"except": a.subtract(b), "reverse": b.subtract(a), "intersect": a.intersect(b), "union": a.union(b).distinct()}
    out = None
    for op, df in named.items():
        df = df.select(F.lit(op).alias("op"), "k")
        out = df if out is None else out.unionByName(df)
    return out


@query("q40_collision_resolution", """SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY nullif(l_extendedprice, 0) NULLS LAST, l_partkey, l_suppkey, l_shipdate) AS r FROM lineitem) WHERE r = 1""")  # fmt: skip
def _(spark, sf):
    priced = table(spark, sf, "lineitem").withColumn("price", F.nullif("l_extendedprice", F.lit(0.0)))
    one = matching.resolve_collisions(priced, ["l_orderkey", "l_linenumber"], "price", F.struct("l_partkey", "l_suppkey", "l_shipdate"))
    return one.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")


@query("q41_first_wins_keep_nulls", """WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS sku FROM events)
 SELECT event_id, coalesce(sku, -1) AS sku FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY event_id) AS r FROM e) WHERE r = 1 OR sku IS NULL""")  # fmt: skip
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("sku", F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("user_id")))
    return matching.first_wins(e, "sku", F.col("event_id")).select("event_id", F.coalesce("sku", F.lit(-1).cast("long")).alias("sku"))


@query("q42_duplicate_keys_audit", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def _(spark, sf):
    return audit.repeated_keys(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("q43_cadence", f"""WITH {OBS}, s AS (SELECT DISTINCT CAST(part AS VARCHAR) AS key, d FROM obs), g AS (SELECT key, d, date_diff('day', lag(d) OVER (PARTITION BY key ORDER BY d), d) AS gap FROM s),
 m AS (SELECT *, median(gap) OVER (PARTITION BY key) AS med FROM g), f AS (SELECT key, max(d) AS last, count(gap) AS gaps, max(med) AS med, median(abs(gap - med)) AS mad FROM m GROUP BY key)
 SELECT key, gaps, med, mad, mad > med/2 AS irregular, CAST(last + CAST(round(med) AS INT) AS DATE) AS next FROM f WHERE gaps >= 1""")  # fmt: skip
def _(spark, sf):
    return history.cadence(observations(spark, sf).select(F.col("part").cast("string").alias("key"), "d"))


@query("q44_missing_weeks", f"""WITH {OBS}, s AS (SELECT DISTINCT CAST(part AS VARCHAR) AS key, d FROM obs), g AS (SELECT key, d, lag(d) OVER (PARTITION BY key ORDER BY d) AS older FROM s)
 SELECT key, CAST(unnest(generate_series(older + 7, d - 4, INTERVAL 7 DAY)) AS DATE) AS missing FROM g WHERE date_diff('day', older, d) >= 11""")  # fmt: skip
def _(spark, sf):
    return trend.missing_weeks(observations(spark, sf).select(F.col("part").cast("string").alias("key"), "d").distinct())


@query("q45_series_swing", f"WITH {OBS}, e AS (SELECT CAST(supp AS VARCHAR) AS key, min(gp) AS low, max(gp) AS high FROM obs WHERE gpf IS NULL AND gp > 0 GROUP BY 1) SELECT * FROM e WHERE high > low*1.5")
def _(spark, sf):
    return audit.swings(observations(spark, sf).withColumn("key", F.col("supp").cast("string")), 1.5)


@query("q46_thin_weeks", f"""WITH {OBS}, c AS (SELECT d, count(*) AS n FROM obs GROUP BY d), u AS (SELECT list_sort(list(n))[CAST(floor(count(*)/2) AS INT) + 1] AS upper FROM c) SELECT d, n, upper FROM c, u WHERE n < upper*0.95""")
def _(spark, sf):
    return audit.thin_weeks(observations(spark, sf).groupBy("d").agg(F.count(F.lit(1)).alias("n")), 0.95)


def _bounded_sql(body: str, column: str) -> str:
    return f"regexp_matches({column}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}])(?:{body})(?:$|[^\\p{{L}}\\p{{N}}])')"


#: Words that occur in the test texts of each language, besides the detectors' own lists.
PROBE = {"der": rf"der|die|das|{detectors.W}heit", "fr": rf"les|{detectors.W}eaux|pour", "es": rf"los|{detectors.W}ción|para", "en": rf"the|{detectors.W}tion|with", "beer": detectors.BEER, "spirits": detectors.SPIRITS}


@query("q47_topic_detectors", "SELECT doc_id, " + ", ".join(f"{_bounded_sql(w, 'text')} AS {n}_topic" for n, w in PROBE.items()) + " FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", *[F.col("text").rlike(text.bounded(w)).alias(f"{n}_topic") for n, w in PROBE.items()])


LEVELS = {"anodized": 2, "steel": -1, "small": 1, "blue": 0, "red": -1}
LIKES = "CASE WHEN {c} LIKE '%{w}%' THEN {v} ELSE 0 END"
VOTES = "v AS (SELECT user_id AS id, CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS BIGINT) AS s, count(*) FILTER (event_type = 'purchase') > 0 AS bought FROM events GROUP BY user_id)"


def _scored(spark, sf):
    e = table(spark, sf, "events")
    v = e.groupBy(F.col("user_id").alias("id")).agg(F.sum(F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", -1).otherwise(0)).alias("s"), (F.count_if(F.col("event_type") == "purchase") > 0).alias("bought"))
    p = table(spark, sf, "part").join(v, F.col("p_partkey") == F.col("id"), "left")
    title = F.lower("p_name")
    matches = {w: title.contains(w) for w in LEVELS}
    vote = F.when(F.col("s") > 0, 1).when(F.col("s") < 0, -1).otherwise(0)
    score = detectors.score(matches, LEVELS, vote, F.coalesce("bought", F.lit(False)))
    return p.select(F.col("p_partkey").alias("id"), "p_name", F.col("p_retailprice").alias("price"), score.cast("long").alias("score"), detectors.vetoed(matches, LEVELS, ("steel",)).alias("vetoed"))


_W = {-1: -4, 0: 0, 1: 2, 2: 4}
SCORED = VOTES + ", sc AS (SELECT p_partkey AS id, p_name, p_retailprice AS price, CAST(" + " + ".join(LIKES.format(c="lower(p_name)", w=w, v=_W[v]) for w, v in LEVELS.items()) + """
 + 6*(CASE WHEN s > 0 THEN 1 WHEN s < 0 THEN -1 ELSE 0 END) + CASE WHEN bought THEN 1 ELSE 0 END AS BIGINT) AS score,
 lower(p_name) LIKE '%steel%' OR (lower(p_name) LIKE '%red%' AND NOT (lower(p_name) LIKE '%anodized%' OR lower(p_name) LIKE '%small%')) AS vetoed FROM part LEFT JOIN v ON p_partkey = id)"""


@query("q48_interest_score", f"WITH {SCORED} SELECT id, score FROM sc")
def _(spark, sf):
    return _scored(spark, sf).select("id", "score")


@query("q49_veto_visibility", f"WITH {SCORED} SELECT id, vetoed, NOT vetoed AND score >= 0 AS visible FROM sc")
def _(spark, sf):
    return _scored(spark, sf).select("id", "vetoed", (~F.col("vetoed") & (F.col("score") >= 0)).alias("visible"))


@query("q50_foryou_backfill", f"""WITH {SCORED}, p AS (SELECT id, row_number() OVER (ORDER BY price DESC, id) AS rank FROM sc WHERE score > 2 AND NOT vetoed ORDER BY price DESC, id LIMIT 5),
 u AS (SELECT id, 0 AS source, CAST(rank AS DOUBLE) AS by FROM p UNION ALL SELECT id, 1, CAST(-score AS DOUBLE) FROM sc WHERE score > 0 AND NOT vetoed AND id NOT IN (SELECT id FROM p))
 SELECT id, source, u.by AS by FROM u ORDER BY source, u.by, id LIMIT 16""")  # fmt: skip
def _(spark, sf):
    s = _scored(spark, sf).where("not vetoed")
    placed = s.where("score > 2").orderBy(F.desc("price"), "id").limit(5)
    placed = placed.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("price"), "id")))  # five rows
    return personal.recommended(placed, s, 16)


@query("q51_section_topn", f"""WITH {STATS}, o AS (SELECT DISTINCT key, title, cat FROM obs), s AS (SELECT key, latest, unnest(list_filter([CASE WHEN title LIKE '%steel%' THEN 'metal' END, CASE WHEN cat LIKE 'PROMO%' THEN 'promo' END, CASE WHEN weeks >= 10 THEN 'steady' END], lambda x: x IS NOT NULL)) AS section, weeks
 FROM stats JOIN o USING (key)), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY weeks DESC, latest, key) AS place FROM s) SELECT section, place, key, latest FROM r WHERE place <= 18""")  # fmt: skip
def _(spark, sf):
    o = observations(spark, sf)
    s = history.product_stats(history.weekly_exact(o)).join(o.select("key", "title", "cat").distinct(), "key")
    named = F.array_compact(F.array(F.when(F.col("title").contains("steel"), "metal"), F.when(F.col("cat").startswith("PROMO"), "promo"), F.when(F.col("weeks") >= 10, "steady")))
    s = s.withColumn("section", F.explode(named)).withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("weeks"), "latest", "key")).cast("long"))
    return s.where("place <= 18").select("section", "place", "key", "latest")


@query("q52_loyalty_store", """SELECT CAST(o_custkey AS VARCHAR) AS norm, count(*) AS c, sum(l_quantity) AS qty, floor(sum(CAST(floor(l_extendedprice*100+0.5) AS BIGINT)) + 0.5)/100 AS spent
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""")  # fmt: skip
def _(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    lines = j.select(F.col("o_custkey").cast("string").alias("norm"), F.col("o_custkey").cast("string").alias("name"), F.col("l_quantity").alias("qty"), (F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("decimal(20,0)")).alias("cents"), F.col("o_orderdate").alias("at"))
    sums = lines.groupBy("norm").agg(F.count(F.lit(1)).alias("c"), F.sum("qty").alias("qty"), F.sum("cents").alias("cents"))
    return sums.select("norm", "c", "qty", (F.floor(F.col("cents").cast("double") + 0.5) / 100).alias("spent"))


@query("q53_tag_affinity", """WITH t AS (SELECT event_type AS tag, sum(CASE WHEN value > 0.5 THEN 1 ELSE -1 END) AS total FROM events GROUP BY 1) SELECT tag, CAST(total AS BIGINT) AS total, CASE WHEN total > 0 THEN 'likes' ELSE 'dislikes' END AS side FROM t WHERE total <> 0""")
def _(spark, sf):
    return personal.affinity(table(spark, sf, "events").select(F.col("event_type").alias("tag"), F.when(F.col("value") > 0.5, 1).otherwise(-1).alias("v")))


@query("q54_shopping_merge", """WITH r AS (SELECT lower(trim(p_brand)) AS norm, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'offer' WHEN 1 THEN 'custom' ELSE 'pantry' END AS grp, p_size = 50 AND p_partkey % 7 = 0 AS removed FROM part),
 b AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY CASE grp WHEN 'offer' THEN 0 WHEN 'custom' THEN 1 ELSE 2 END, name) AS place, max(removed::INT) OVER (PARTITION BY norm) AS gone FROM r)
 SELECT norm, name, grp FROM b WHERE place = 1 AND gone = 0""")  # fmt: skip
def _(spark, sf):
    p = table(spark, sf, "part")
    grp = F.when(F.col("p_size") % 3 == 0, "offer").when(F.col("p_size") % 3 == 1, "custom").otherwise("pantry")
    return personal.shopping_list(p.select(text.norm_title(F.col("p_brand")).alias("norm"), F.col("p_name").alias("name"), grp.alias("grp"), ((F.col("p_size") == 50) & (F.col("p_partkey") % 7 == 0)).alias("removed")))


@query("q55_comma_dot_search", "SELECT p_partkey, p_name FROM part WHERE contains(replace(lower(p_name || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR) || ',5'), ',', '.'), 'steel') OR contains(replace(CAST(p_size AS VARCHAR) || ',5', ',', '.'), '1.5')")
def _(spark, sf):
    blob = F.translate(F.lower(F.concat_ws(" ", "p_name", "p_type", F.concat(F.col("p_size").cast("string"), F.lit(",5")))), ",", ".")
    price = F.translate(F.concat(F.col("p_size").cast("string"), F.lit(",5")), ",", ".")
    return table(spark, sf, "part").where(blob.contains("steel") | price.contains("1.5")).select("p_partkey", "p_name")


FOLD = "replace(strip_accents(lower(text)), 'ß', 'ss')"


@query("q56_all_tokens_search", f"SELECT doc_id FROM documents WHERE contains({FOLD}, 'tion') AND contains({FOLD}, 'le') AND contains({FOLD}, 'eau')")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("hay", text.search_fold(F.col("text")))
    return d.where(F.forall(F.array(*map(F.lit, ("tion", "le", "eau"))), lambda t: F.contains(F.col("hay"), t))).select("doc_id")


UML = "replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"


@query("q57_umlaut_search", f"SELECT lang, count(*) AS n FROM documents WHERE contains({UML}, 'ueber') OR contains({UML}, 'oe') GROUP BY lang")
def _(spark, sf):
    f = text.fold_umlauts(F.col("text"))
    return table(spark, sf, "documents").where(f.contains("ueber") | f.contains("oe")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


for _name, _dir in (("q58_null_last_ascending", "ASC"), ("q58_null_last_descending", "DESC")):

    @query(_name, f"SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders ORDER BY status {_dir} NULLS LAST, o_orderkey")
    def _(spark, sf, up=_dir == "ASC"):
        o = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
        return o.orderBy(F.col("status").asc_nulls_last() if up else F.col("status").desc_nulls_last(), "o_orderkey")


@query("q59_weekly_bucket", "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return ingest.weekly_unique(table(spark, sf, "events"), "event_id", "ts")


@query("q59_iso_week_label", """SELECT CAST(isoyear(o_orderdate) AS VARCHAR) || '-KW' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS label,
 CAST(year(date_trunc('week', o_orderdate + INTERVAL 6 HOUR)) AS VARCHAR) AS folder, CAST(min(date_trunc('week', o_orderdate + INTERVAL 6 HOUR)) AS DATE) AS monday, count(*) AS n FROM orders GROUP BY 1, 2""")  # fmt: skip
def _(spark, sf):
    o = table(spark, sf, "orders")
    monday = F.date_trunc("week", F.col("o_orderdate") + F.expr("interval 6 hours"))
    label = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("o_orderdate")).cast("string"), F.lit("-KW"), F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0"))
    return o.select(label.alias("label"), F.year(monday).cast("string").alias("folder"), monday.cast("date").alias("monday")).groupBy("label", "folder").agg(F.min("monday").alias("monday"), F.count(F.lit(1)).alias("n"))


@query("q60_link_extract", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))


@query("q61_norm_desc_and_minted_id", """WITH n AS (SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower('je ' || p_name || ' ca. ' || p_type || '-' || p_brand), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: w NOT IN ('', 'je', 'ca', 'versch', 'sorten')))), ' ') AS norm, p_brand FROM part)
 SELECT p_partkey, norm, substr(sha1(p_brand || '|' || norm), 1, 12) AS id FROM n""")  # fmt: skip
def _(spark, sf):
    norm = text.norm_desc(F.concat(F.lit("je "), F.col("p_name"), F.lit(" ca. "), F.col("p_type"), F.lit("-"), F.col("p_brand")))
    return table(spark, sf, "part").withColumn("norm", norm).select("p_partkey", "norm", text.minted_id(F.col("p_brand"), F.col("norm")).alias("id"))


@query("q62_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_QUARTER = "sum(CAST('0x' || substr(m, {}, 8) AS BIGINT))::VARCHAR"


@query("q63_churn_hash", f"""WITH {OBS}, h AS (SELECT d, md5(CAST(json_object('face', face, 'l_linenumber', l_linenumber, 'l_orderkey', l_orderkey, 'part', part, 'supp', supp) AS VARCHAR)) AS m FROM obs)
 SELECT d, count(*) AS n, md5(concat_ws('|', count(*)::VARCHAR, {", ".join(_QUARTER.format(8 * k + 1) for k in range(4))})) AS hash FROM h GROUP BY d""")  # fmt: skip
def _(spark, sf):
    """The weeks' hashes, which neither the order of rows nor other columns change."""
    return ingest.canonical_hash(observations(spark, sf), "d", ["l_orderkey", "l_linenumber", "part", "supp", "face"]).select("d", "n", "hash")


@query("q64_stream_weekly_unique", "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def _(spark, sf):
    """The same counts from a stream that runs to its present end; its state and result lie in the shared folder."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a zoned timestamp
    weeks, folder = ingest.weekly_unique(stream, "event_id", "ts", "60 days"), sinks.shared_folder(spark, "weekly-unique")
    ingest.ingest(weeks, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/weeks"), f"{folder}/state", "complete")
    return spark.read.schema(weeks.schema).parquet(f"{folder}/weeks")


@query("q65_ordered_replacement", None)
def _(spark, sf):
    swap = text.replace_once(((r"\bthe\b", "a"), (r"\band\b", "the"), (r"\bder\b", "die")))
    return table(spark, sf, "documents").select("doc_id", swap("text").alias("text"))


@query("q66_audit_report", f"""WITH {OBS}, c AS (SELECT d, count(*) AS n FROM obs GROUP BY d), u AS (SELECT list_sort(list(n))[CAST(floor(count(*)/2) AS INT) + 1] AS upper FROM c),
 k AS (SELECT count(*) AS n FROM (SELECT 1 FROM obs GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)), s AS (SELECT count(*) AS n FROM (SELECT key FROM obs WHERE gpf IS NULL AND gp > 0 GROUP BY key HAVING max(gp) > min(gp)*8)),
 g AS (SELECT d, lag(d) OVER (ORDER BY d) AS older FROM (SELECT DISTINCT d FROM obs)), m AS (SELECT count(*) AS n FROM (SELECT unnest(generate_series(older + 7, d - 4, INTERVAL 7 DAY)) FROM g WHERE date_diff('day', older, d) >= 11))
 SELECT * FROM (SELECT 'repeated id' AS "check", 'note' AS severity, n FROM k UNION ALL SELECT 'thin week', 'fail', (SELECT count(*) FROM c, u WHERE c.n < upper*0.6) UNION ALL SELECT 'swing', 'note', n FROM s UNION ALL SELECT 'missing week', 'fail', n FROM m) WHERE n > 0""")  # fmt: skip
def _(spark, sf):
    return audit.report(observations(spark, sf)).groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("q67_observed_to_declared", """WITH w AS (SELECT o_orderkey, count(l_orderkey) AS observed, o_orderkey % 7 + 1 AS declared FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
 SELECT count(*) AS thin, floor(min(observed/declared::DOUBLE)*1e6+0.5)/1e6 AS worst FROM w WHERE observed/declared::DOUBLE < 0.9""")  # fmt: skip
def _(spark, sf):
    seen = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("observed"))
    w = table(spark, sf, "orders").select("o_orderkey").join(seen, "o_orderkey", "left").withColumn("ratio", F.coalesce("observed", F.lit(0)) / (F.col("o_orderkey") % 7 + 1))
    return w.where("ratio < 0.9").agg(F.count(F.lit(1)).alias("thin"), round6(F.min("ratio")).alias("worst"))


@query("q68_one_to_one_match", """WITH w AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS turn FROM part WHERE p_size > 40), o AS (SELECT p_partkey AS offer, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice, p_partkey) AS turn FROM part WHERE p_size < 5)
 SELECT p_name, p_partkey, offer FROM w JOIN o USING (p_name, turn)""")  # fmt: skip
def _(spark, sf):
    p = table(spark, sf, "part")
    wanted, offered = p.where("p_size > 40").select("p_partkey", "p_name"), p.where("p_size < 5").select(F.col("p_partkey").alias("offer"), "p_name", "p_retailprice")
    return matching.one_to_one(wanted, offered, "p_name", F.col("p_partkey"), F.struct("p_retailprice", "offer")).select("p_name", "p_partkey", "offer")


@query("q69_vote_and_basket_lookup", f"""WITH {VOTES} SELECT p_partkey AS id, p_name, coalesce(s, 0) AS votes, coalesce(bought, false) AS bought FROM part LEFT JOIN v ON p_partkey = v.id""")
def _(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("p_partkey"))
    v = e.agg(F.sum(F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", -1).otherwise(0)).alias("s"), (F.count_if(F.col("event_type") == "purchase") > 0).alias("bought"))
    return table(spark, sf, "part").join(v, "p_partkey", "left").select(F.col("p_partkey").alias("id"), "p_name", F.coalesce("s", F.lit(0).cast("long")).alias("votes"), F.coalesce("bought", F.lit(False)).alias("bought"))


@query("q70_manifest_differences", """WITH m AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), f AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
 SELECT d, 'left' AS side FROM (SELECT d FROM m EXCEPT SELECT d FROM f) UNION ALL SELECT d, 'right' FROM (SELECT d FROM f EXCEPT SELECT d FROM m)""")  # fmt: skip
def _(spark, sf):
    return matching.differences(table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")), table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")))


@query("q71_sectioned_digest", """WITH s AS (SELECT p_partkey AS id, unnest(list_filter([CASE WHEN p_name LIKE '%small%' THEN 'small' END, CASE WHEN p_type LIKE 'PROMO%' THEN 'promo' END], lambda x: x IS NOT NULL)) AS section, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS pctile, p_size % 5 = 0 AS best FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY pctile IS NULL, CASE WHEN pctile IS NULL THEN 1 WHEN best THEN 0 ELSE 1 END, coalesce(pctile, 100), id) AS place FROM s) SELECT section, place, id FROM r WHERE place <= 18""")  # fmt: skip
def _(spark, sf):
    p = table(spark, sf, "part")
    named = F.array_compact(F.array(F.when(F.col("p_name").contains("small"), "small"), F.when(F.col("p_type").startswith("PROMO"), "promo")))
    pctile = F.when(F.col("p_size") % 3 != 0, F.col("p_size"))
    s = p.select(F.col("p_partkey").alias("id"), F.explode(named).alias("section"), pctile.alias("pctile"), F.when(pctile.isNotNull(), F.col("p_size") % 5 == 0).alias("best"))
    order = Window.partitionBy("section").orderBy(F.col("pctile").isNull(), F.coalesce(~F.col("best"), F.lit(True)), F.coalesce("pctile", F.lit(100)), "id")
    return s.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 18").select("section", "place", "id")


@query("q72_validated_recommendations", """WITH r AS (SELECT o_custkey AS reply, o_orderkey AS rank, 'part ' || CAST(o_orderkey % 60 AS VARCHAR) AS title FROM orders), c AS (SELECT DISTINCT 'part ' || CAST(p_size AS VARCHAR) AS title FROM part)
 SELECT reply, title, row_number() OVER (PARTITION BY reply ORDER BY rank, title) AS rank FROM r WHERE title IN (SELECT title FROM c)""")  # fmt: skip
def _(spark, sf):
    title = lambda c: F.concat(F.lit("part "), c.cast("string")).alias("title")
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("reply"), F.col("o_orderkey").alias("rank"), title(F.col("o_orderkey") % 60), F.lit("why").alias("reason"), F.lit("cheap").alias("tag"))
    return digest.validated(r, table(spark, sf, "part").select(title(F.col("p_size")))).select("reply", "title", F.col("rank").cast("long").alias("rank"))


@query("q73_verbatim_share", """WITH r AS (SELECT o_custkey AS reply, 'part ' || CAST(o_orderkey % 60 AS VARCHAR) AS title FROM orders), c AS (SELECT DISTINCT 'part ' || CAST(p_size AS VARCHAR) AS title FROM part)
 SELECT reply, count(*) AS n, CAST(floor(avg(CASE WHEN title IN (SELECT title FROM c) THEN 1 ELSE 0 END)*100 + 0.5) AS BIGINT) AS verbatim_pct FROM r GROUP BY reply""")  # fmt: skip
def _(spark, sf):
    title = lambda c: F.concat(F.lit("part "), c.cast("string")).alias("title")
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("reply"), title(F.col("o_orderkey") % 60))
    return digest.verbatim_share(r, table(spark, sf, "part").select(title(F.col("p_size"))))


@query("q74_visible_rows_export", """SELECT '{"title":"' || p_name || '","category":"' || p_type || '"}' AS value FROM part WHERE p_size > 25""")
def _(spark, sf):
    return sinks.as_json(table(spark, sf, "part").where("p_size > 25").select(F.col("p_name").alias("title"), F.col("p_type").alias("category")), ["title", "category"])


@query("q75_shopping_text", """WITH i AS (SELECT p_type AS grp, '- [ ] ' || p_name AS line FROM (SELECT DISTINCT p_type, p_name FROM part)) SELECT grp, string_agg(line, chr(10) ORDER BY line) AS text FROM i GROUP BY grp""")
def _(spark, sf):
    return personal.grouped_text(table(spark, sf, "part").select(F.col("p_type").alias("grp"), F.col("p_name").alias("name")).distinct())


@query("q76_trend_index", f"""WITH {OBS}, c AS (SELECT d, cat, count(*) AS n FROM obs GROUP BY d, cat) SELECT d, CAST(sum(n) AS BIGINT) AS total, string_agg(cat || '=' || CAST(n AS VARCHAR), ';' ORDER BY cat) AS counts FROM c GROUP BY d""")
def _(spark, sf):
    t = trend.trend_index(observations(spark, sf), SANE)
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return t.select("d", "total", F.array_join(F.array_sort(pairs), ";").alias("counts"))


@query("q77_newest_variant", f"WITH {OBS} SELECT title, CAST(arg_max(gp, (d, l_orderkey, l_linenumber, part, supp)) AS DOUBLE) AS newest, count(DISTINCT part) AS variants, count(DISTINCT d) AS weeks, min(d) AS first_d, max(d) AS last_d FROM obs GROUP BY title")
def _(spark, sf):
    o = observations(spark, sf)
    order = F.struct("d", "l_orderkey", "l_linenumber", "part", "supp")
    return o.groupBy("title").agg(F.max_by("gp", order).alias("newest"), F.count_distinct("part").alias("variants"), F.count_distinct("d").alias("weeks"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


@query("q78_money_and_badges", """SELECT p_partkey, printf('%.2f', p_retailprice) || ' €' AS plain, replace(printf('%.2f', p_retailprice), '.', ',') || ' €' AS comma,
 CASE WHEN p_size % 2 = 0 THEN 'PAYBACK +' || CAST(p_size AS VARCHAR) || ' P' ELSE '' END AS badges FROM part""")  # fmt: skip
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("criteria", F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.lit(scalars.BONUS).alias("name")))))
    shown = F.array_join(scalars.badges(F.col("criteria"), F.col("p_size"), F.lit(None).cast("double")), ",")
    return p.select("p_partkey", scalars.money(F.col("p_retailprice")).alias("plain"), scalars.money(F.col("p_retailprice"), "comma").alias("comma"), shown.alias("badges"))
