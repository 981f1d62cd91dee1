"""Queries over what a reader sees, personal data, digests and audits, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import detectors, scalars, text
from ..functions.unitprice import round6, with_resolved, with_size_bucket
from ..operators import audit, digest, history, matching, personal, pricecheck, selection
from ..sources import sinks
from ..sources.tables import date_labels, observations, table, worded_offers
from ..streaming import ingest
from .archive import OBS, OVER, R6, RADAR, SCORED, WORDED, _latest, _radar, _scored, query

O = """o AS (SELECT p_partkey AS id, p_name AS title, p_type AS category, p_brand AS description, p_size AS size, p_retailprice AS price, p_size % 5 = 0 AS flagged,
 CASE WHEN p_size % 3 <> 0 THEN p_size END AS pctile, CASE WHEN p_size % 3 <> 0 THEN p_size % 5 = 0 END AS best FROM part)"""
HIDDEN = ("SMALL", "PROMO")
ACTIVE = "a AS (SELECT DISTINCT category FROM o WHERE category NOT IN ('SMALL', 'PROMO'))"


def _offers(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    with_history = F.col("p_size") % 3 != 0
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_brand").alias("description"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 5 == 0).alias("flagged"),
        F.when(with_history, F.col("p_size")).alias("pctile"), F.when(with_history, F.col("p_size") % 5 == 0).alias("best"),
    )


for _name, _flag, _where in (("q79_active_categories", False, ""), ("q80_flagged_in_categories", True, " AND flagged")):

    @query(_name, f"WITH {O}, {ACTIVE} SELECT id, category FROM o WHERE category IN (SELECT category FROM a){_where}")
    def _(spark, sf, flag=_flag):
        o = _offers(spark, sf)
        return selection.allowed(o, selection.active_categories(o, HIDDEN), flag).select("id", "category")


@query("q81_title_or_description_search", f"WITH {O} SELECT id, title FROM o WHERE contains(lower(title), 'ring') OR contains(lower(description), '#2') ORDER BY title, id LIMIT 50")
def _(spark, sf):
    """Two terms, each against titles and descriptions alike; the first 50 of both together."""
    o = _offers(spark, sf)
    both = selection.title_or_description(o, " RING ").unionByName(selection.title_or_description(o, "#2")).dropDuplicates(["id"])
    return both.orderBy("title", "id").limit(50).select("id", "title")


HAY = "lower(title || ' ' || category || ' ' || description)"


@query("q82_topic_search", f"WITH {O} SELECT id FROM o WHERE contains({HAY}, 'brand') AND (contains({HAY}, 'gadg') OR category = 'ECONOMY') AND contains({HAY}, 'co')")
def _(spark, sf):
    """'gadg' is part of a title or of the label of a topic; 'co' is too short to name one."""
    o = _offers(spark, sf)
    hay = text.search_fold(F.concat_ws(" ", "title", "category", "description"))
    topics = {"Gadgets & Co": F.col("category") == "ECONOMY", "Metall": F.col("title").contains("steel")}
    return o.where(selection.all_tokens(hay, "Bránd  gadg co", topics)).select("id")


@query("q83_browse_order", f"WITH {SCORED}, h AS (SELECT id, p_name AS title, vetoed OR score < 0 AS hidden FROM sc) SELECT id, title, hidden FROM h ORDER BY hidden, lower(title), id")
def _(spark, sf):
    s = _scored(spark, sf).select("id", F.col("p_name").alias("title"), (F.col("vetoed") | (F.col("score") < 0)).alias("hidden"))
    return selection.browsed(s)


@query("q84_hidden_and_shown", f"WITH {SCORED} SELECT count(*) FILTER (vetoed OR score < 0) AS hidden, count(*) FILTER (NOT (vetoed OR score < 0)) AS shown FROM sc")
def _(spark, sf):
    return selection.shown_and_hidden(_scored(spark, sf).select((F.col("vetoed") | (F.col("score") < 0)).alias("hidden")))


PART_PRIOR = OBS + f""", pw AS (SELECT part AS key, d, min(gp) AS gp FROM obs WHERE gpf IS NULL GROUP BY part, d),
 pp AS (SELECT *, min(gp) OVER b AS prior_low, count(*) OVER b AS prior FROM pw WINDOW b AS (PARTITION BY key ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 pt AS (SELECT key, d, CASE WHEN gp <= prior_low + 1e-9 THEN 'best' WHEN {OVER} <= 10 THEN 'good' WHEN {OVER} >= 20 THEN 'wait' END AS tier FROM pp WHERE prior >= 2),
 now AS (SELECT pt.key AS id, tier FROM pt JOIN (SELECT key, max(d) AS d FROM pt GROUP BY key) m ON pt.key = m.key AND pt.d = m.d)"""


@query("q85_discoveries", f"""WITH {PART_PRIOR}, {SCORED}, vv AS (SELECT id, s FROM v), placed AS (SELECT id FROM sc WHERE NOT vetoed ORDER BY price DESC, id LIMIT 5)
 SELECT sc.id, now.tier FROM sc JOIN now ON sc.id = now.id LEFT JOIN vv ON vv.id = sc.id WHERE NOT vetoed AND score = 0 AND coalesce(sign(s), 0) <> -1 AND tier IN ('best', 'good')
 AND sc.id NOT IN (SELECT id FROM placed) ORDER BY tier <> 'best', sc.id LIMIT 10""")  # fmt: skip
def _(spark, sf):
    weekly = history.weekly_exact(observations(spark, sf).withColumn("key", F.col("part")))
    now = pricecheck.tiers(weekly).groupBy(F.col("key").alias("id")).agg(F.max(F.struct("d", "tier")).alias("last")).select("id", "last.tier")
    scored = _scored(spark, sf)
    placed = scored.where("not vetoed").orderBy(F.desc("price"), "id").limit(5)
    votes = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.signum(F.sum(F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", -1).otherwise(0))).alias("vote"))
    offers = scored.join(now, "id").join(votes, "id", "left").withColumn("vote", F.coalesce("vote", F.lit(0.0)))
    return selection.discoveries(offers, placed, 10).select("id", "tier")


@query("q86_best_deal", f"""WITH {RADAR}, k AS (SELECT count(*) FILTER (over <= 0.001) AS at_low, arg_min(key, (over, key)) AS best FROM radar), n AS (SELECT at_low, best, p_name AS title FROM k JOIN part ON CAST(p_partkey AS VARCHAR) = split_part(best, '|', 1))
 SELECT at_low, best, title, (SELECT min(p_partkey) FROM part WHERE p_name = n.title) AS offer FROM n""")  # fmt: skip
def _(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    best = history.at_low(_radar(spark, sf)).withColumn("part", F.split("best", r"\|")[0].cast("long"))
    named = best.join(parts, best["part"] == parts["id"]).select("at_low", "best", "title")
    return matching.first_of_title(named, parts, F.col("id")).select("at_low", "best", "title", "offer")


@query("q87_declared_totals", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 + 1 END, count(l_orderkey)) AS total FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def _(spark, sf):
    seen = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    declared = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 7 + 1)
    return table(spark, sf, "orders").join(seen, "o_orderkey", "left").select("o_orderkey", F.coalesce(declared, "n", F.lit(0)).cast("long").alias("total"))


@query("q88_index_envelope", f"WITH {OBS} SELECT max(d) AS latest, count(DISTINCT d) AS n_weeks, string_agg(DISTINCT CAST(d AS VARCHAR), ',' ORDER BY CAST(d AS VARCHAR)) AS weeks FROM obs")
def _(spark, sf):
    e = history.envelope(observations(spark, sf))
    return e.select("latest", F.size("weeks").cast("long").alias("n_weeks"), F.array_join(F.transform("weeks", lambda d: d.cast("string")), ",").alias("weeks"))


@query("q89_corpus_totals", f"""WITH {WORDED} SELECT count(*) AS offers, count(*) FILTER (l_linenumber % 6 <> 4) AS priced, count(*) FILTER (l_linenumber % 6 = 0) AS native, count(*) FILTER (l_linenumber % 6 IN (1, 2)) AS described,
 count(*) FILTER (l_linenumber % 6 IN (3, 5)) AS derived, {R6.format("count(*) FILTER (l_linenumber % 6 IN (3, 5)) / count(*) FILTER (l_linenumber % 6 <> 4)::DOUBLE")} AS derived_share FROM worded""")  # fmt: skip
def _(spark, sf):
    w = worded_offers(spark, sf)
    native = F.col("l_linenumber") % 6 == 0
    w = w.withColumns({"native": native, "basic": F.when(native, F.col("wording")), "rest": F.when(~native, F.col("wording"))})
    return history.totals(with_resolved(w, F.col("basic"), F.lit(None).cast("string"), F.col("rest"), F.col("face"), "r"))


@query("q90_variant_order", f"""WITH {OBS}, f AS (SELECT title, key, bool_or(d = (SELECT max(d) FROM obs)) AS offered, count(*) AS n_obs FROM obs GROUP BY title, key)
 SELECT title, key, offered, n_obs, row_number() OVER (PARTITION BY title ORDER BY offered DESC, n_obs DESC, key) AS place FROM f""")  # fmt: skip
def _(spark, sf):
    o = observations(spark, sf)
    found = history.variants(o, o.agg(F.max("d").alias("d")))
    return found.select("title", "key", "offered", "n_obs", F.col("place").cast("long").alias("place"))


@query("q91_newest_history", f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY supp ORDER BY d DESC, l_orderkey DESC, l_linenumber DESC, part DESC, face DESC) AS place FROM obs)
 SELECT supp, d, l_orderkey, l_linenumber, part, face, place FROM r WHERE place <= 30""")  # fmt: skip
def _(spark, sf):
    n = history.newest(observations(spark, sf), "supp", "d", "l_orderkey", "l_linenumber", "part", "face")
    return n.select("supp", "d", "l_orderkey", "l_linenumber", "part", "face", F.col("place").cast("long").alias("place"))


@query("q92_most_bought", "SELECT c_name AS name, count(*) AS c FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name ORDER BY c DESC, name LIMIT 20")
def _(spark, sf):
    bought = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("c"))
    return personal.most_bought(table(spark, sf, "customer").join(bought, "c_custkey").select(F.col("c_name").alias("name"), "c"))


@query("q93_admission_guards", """WITH w AS (SELECT o_orderkey, count(l_orderkey) AS n, o_orderkey % 9 AS declared FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
 SELECT o_orderkey, n, CASE WHEN n < 2 THEN 'too few' WHEN declared > 0 AND n < 0.9*declared THEN 'page lost' END AS refused FROM w""")  # fmt: skip
def _(spark, sf):
    seen = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    w = table(spark, sf, "orders").select("o_orderkey").join(seen, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"), (F.col("o_orderkey") % 9).alias("declared"))
    return ingest.admitted(w, 2).select("o_orderkey", "n", "refused")


PART_GAPS = OBS + """, s AS (SELECT DISTINCT CAST(part AS VARCHAR) AS key, d FROM obs), g AS (SELECT key, d, lag(d) OVER (PARTITION BY key ORDER BY d) AS older FROM s),
 m AS (SELECT key, CAST(unnest(generate_series(older + 7, d - 4, INTERVAL 7 DAY)) AS DATE) AS missing FROM g WHERE date_diff('day', older, d) >= 11)"""


@query("q94_known_gaps", f"WITH {PART_GAPS} SELECT key, missing, missing IN (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS known FROM m")
def _(spark, sf):
    known = table(spark, sf, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.date_trunc("week", "o_orderdate").cast("date").alias("missing"))
    return audit.gaps(observations(spark, sf).select(F.col("part").cast("string").alias("key"), "d").distinct(), known)


@query("q95_week_identity", """WITH s AS (SELECT o_orderkey AS file, CAST(o_orderdate AS DATE) AS d, 'KW' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS kw, CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT) ELSE CAST(o_orderdate AS DATE) END AS valid_from FROM orders)
 SELECT file, d, valid_from FROM s WHERE valid_from IS NULL OR valid_from <> d OR kw <> 'KW' || lpad(CAST(week(valid_from) AS VARCHAR), 2, '0')""")  # fmt: skip
def _(spark, sf):
    key, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    valid = F.when(key % 50 == 0, None).when(key % 4 == 0, F.date_add(d, (key % 9).cast("int"))).otherwise(d)
    kw = F.concat(F.lit("KW"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    return audit.misfiled(table(spark, sf, "orders").select(key.alias("file"), d.alias("d"), kw.alias("kw"), valid.alias("valid_from"))).select("file", "d", "valid_from")


@query("q96_repeated_weeks", f"""WITH {OBS}, f AS (SELECT d AS valid_from, count(DISTINCT supp % 3) AS files FROM obs GROUP BY d HAVING count(DISTINCT supp % 3) > 1), e AS (SELECT d AS valid_from, title, count(DISTINCT supp % 3) AS held FROM obs GROUP BY d, title)
 SELECT valid_from, files, count(*) FILTER (held = files) AS shared FROM e JOIN f USING (valid_from) GROUP BY valid_from, files""")  # fmt: skip
def _(spark, sf):
    return audit.repeated_weeks(observations(spark, sf).select(F.col("d").alias("valid_from"), (F.col("supp") % 3).alias("file"), "title"))


@query("q97_unusable_offers", f"""WITH {OBS} SELECT 'unusable price' AS "check", 'note' AS severity, CAST(l_orderkey AS VARCHAR) AS entity, count(*) AS n FROM obs WHERE face > 90000 GROUP BY l_orderkey
 UNION ALL SELECT 'no title or category', 'fail', CAST(l_orderkey AS VARCHAR), count(*) FROM obs WHERE part % 100 = 0 GROUP BY l_orderkey""")  # fmt: skip
def _(spark, sf):
    o = observations(spark, sf).select(F.col("l_orderkey").alias("id"), F.when(F.col("part") % 100 != 0, F.col("title")).otherwise("").alias("title"), F.col("cat").alias("category"), "face")
    return audit.unusable(o, 90000.0).groupBy("check", "severity", "entity").agg(F.count(F.lit(1)).alias("n"))


SIBLING = """s AS (SELECT o_orderpriority AS source, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS h FROM orders GROUP BY 1, 2),
 t AS (SELECT source, CASE WHEN h % 10 = 0 THEN monday + 1 ELSE monday END AS d, monday, n, h FROM s WHERE h % 7 <> 0),
 g AS (SELECT source, d, lag(d) OVER (PARTITION BY source ORDER BY d) AS older FROM t),
 m AS (SELECT source, CAST(unnest(generate_series(older + 7, d - 4, INTERVAL 7 DAY)) AS DATE) AS missing FROM g WHERE date_diff('day', older, d) >= 11)"""


@query("q98_sibling_archive", f"""WITH {SIBLING} SELECT 'misfiled' AS "check", 'fail' AS severity, source || '/' || CAST(d AS VARCHAR) AS entity FROM t WHERE d <> monday
 UNION ALL SELECT CASE WHEN month(missing) = 1 THEN 'known gap' ELSE 'missed week' END, CASE WHEN month(missing) = 1 THEN 'note' ELSE 'fail' END, source FROM m
 UNION ALL SELECT 'thin', 'fail', source || '/' || CAST(d AS VARCHAR) FROM t WHERE n < 3 UNION ALL SELECT 'short of declared', 'fail', source || '/' || CAST(d AS VARCHAR) FROM t WHERE h % 5 + 1 > 0 AND n < 0.9*(h % 5 + 1)
 UNION ALL SELECT 'repeated key', 'fail', source || '/' || CAST(d AS VARCHAR) || '/' || CAST(key AS VARCHAR) FROM (SELECT o_orderpriority AS source, CAST(date_trunc('week', o_orderdate) AS DATE) AS d, o_custkey AS key FROM orders GROUP BY ALL HAVING count(*) > 1)""")  # fmt: skip
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), F.date_trunc("week", "o_orderdate").cast("date").alias("monday"), "o_orderkey", "o_custkey")
    s = orders.groupBy("source", "monday").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("h")).where("h % 7 <> 0")
    d = F.when(F.col("h") % 10 == 0, F.date_add("monday", 1)).otherwise(F.col("monday"))
    kw = F.concat(F.lit("KW"), F.lpad(F.weekofyear("d").cast("string"), 2, "0"))
    s = s.withColumn("d", d).select("source", F.year("d").cast("string").alias("year"), kw.alias("kw"), "d", F.col("monday").alias("week_start"), (F.col("h") % 5 + 1).alias("total"), "n")
    days = F.explode(F.expr("sequence(date'1994-01-01', date'2003-12-31', interval 1 day)"))
    known = spark.range(1).select(days.alias("missing")).where(F.month("missing") == 1)
    keys = orders.select("source", F.col("monday").alias("d"), F.col("o_custkey").alias("key"))
    return audit.sibling_report(s, keys, known, least=3).select("check", "severity", "entity")


@query("q99_image_coverage", f"""WITH {OBS}, w AS (SELECT d, count(*) FILTER (l_orderkey % 3 <> 0) AS have, count(*) AS total FROM obs GROUP BY d) SELECT d, have, total FROM w WHERE d >= (SELECT min(d) FROM w WHERE have > 0) AND total > 0 AND have/total::DOUBLE < 0.66""")
def _(spark, sf):
    w = observations(spark, sf).groupBy("d").agg(F.count_if(F.col("l_orderkey") % 3 != 0).alias("have"), F.count(F.lit(1)).alias("total"))
    return audit.coverage(w, 0.66)


@query("q100_date_labels", """SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%d.%m.%Y') AS long_date, strftime(o_orderdate, '%d.%m.') AS short_date, 'KW' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS week_label FROM orders""")
def _(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("d")).cast("string"), F.lit("-KW"), F.lpad(F.weekofyear("d").cast("string"), 2, "0"))
    return d.select("d", *date_labels(F.col("d").cast("string"), week))


@query("q101_latest_week_label", f"WITH {OBS}, t AS (SELECT DISTINCT d, CAST(isoyear(d) AS VARCHAR) || '-KW' || lpad(CAST(week(d) AS VARCHAR), 2, '0') AS week FROM obs) SELECT d AS latest, week FROM t WHERE d = (SELECT max(d) FROM t)")
def _(spark, sf):
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("d")).cast("string"), F.lit("-KW"), F.lpad(F.weekofyear("d").cast("string"), 2, "0"))
    weeks = observations(spark, sf).select("d").distinct().withColumn("week", week)
    return weeks.agg(F.max("d").alias("latest"), F.max_by("week", "d").alias("week"))


@query("q102_current_brochures", """WITH b AS (SELECT event_id AS brochure, event_type AS publisher, ts AS valid_from, CAST(date_trunc('week', ts + INTERVAL 6 HOUR) AS DATE) AS week FROM events),
 r AS (SELECT * FROM (VALUES ('A', 'click'), ('B', 'signup'), ('C', 'Click')) v(retailer, publisher)), p AS (SELECT retailer, brochure, week, row_number() OVER (PARTITION BY retailer ORDER BY valid_from, brochure) AS place FROM b JOIN r USING (publisher) WHERE week >= DATE '2024-01-15')
 SELECT retailer, place, brochure, week FROM p WHERE place <= 4""")  # fmt: skip
def _(spark, sf):
    b = table(spark, sf, "events").select(F.col("event_id").alias("brochure"), F.col("event_type").alias("publisher"), F.col("ts").alias("valid_from"))
    r = spark.createDataFrame([("A", "click"), ("B", "signup"), ("C", "Click")], "retailer string, publisher string")
    return matching.current_brochures(b, r, F.lit("2024-01-15").cast("date"), 4).select("retailer", F.col("place").cast("long").alias("place"), "brochure", "week")


#: Offers whose verdicts are known: title, description, category, base unit, face price; then unit,
#: unit price, size bucket, meat, fish, spirits, vegan, and the two vetoes.
KNOWN = (
    ("Jackdaniel's Whiskey", "", "Getränke", "0,7 l Flasche", 14.0, "l", 20.0, "v-1", False, False, True, False, False, False),
    ("Jack Daniel's", "", "Getränke", "0,35 l", 7.0, "l", 20.0, "v-1", False, False, True, False, False, False),
    ("Geschirrspültabs", "", "Drogerie", "30 Tabs", 6.0, "Tab", 0.2, "c1", False, False, False, False, False, False),
    ("Spülcaps", "", "Drogerie", "30 Caps Packung", 6.0, "Tab", 0.2, "c1", False, False, False, False, False, False),
    ("Cap Colour", "", "Drogerie", "1 Cap", 0.5, "Tab", 0.5, "c0", False, False, False, False, False, False),
    ("Waschmittel", "", "Drogerie", "20 WL", 5.0, "WA", 0.25, "c1", False, False, False, False, False, False),
    ("veggie Würstchen", "", "Fleisch & Wurst", "200 g", 2.0, "kg", 10.0, "w-1", False, False, False, True, False, False),
    ("Aufschnitt", "", "Fleisch & Wurst", "je 200 g / 250 g", 2.0, None, None, "w-1", False, False, False, False, True, False),
    ("Räucherlachs", "", "Molkerei & Käse", "100 g", 3.0, "kg", 30.0, "w-1", False, True, False, False, False, True),
    ("Lachsfilet", "vegane Art", "Tiefkühl", "6 x 50 g", 3.0, None, None, "w-2", False, False, False, True, False, False),
    ("Rumänische Beeren", "", "Obst & Gemüse", "offene Ware 500 g", 3.0, None, None, "w-1", False, False, False, False, False, False),
    ("Wiener Boden", "", "Grundnahrung", "3 Stück", 3.0, "St", 1.0, "c0", False, False, False, False, False, False),
    ("Wiener Würstchen", "", "Grundnahrung", "6 Stk", 3.0, "St", 0.5, "c0", True, False, False, False, True, False),
)
_VERDICT = "unit gp bucket meat fish spirits vegan veto_meat veto_fish".split()


def _literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"


KNOWN_SQL = "k AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(map(_literal, row[5:]))})" for i, row in enumerate(KNOWN)) + f") v(pos, {', '.join(_VERDICT)}))"


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    names = "title description category base_unit face".split()
    known = spark.createDataFrame([(i, *row[:5]) for i, row in enumerate(KNOWN)], "at long, title string, description string, category string, base_unit string, face double")
    offers = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % len(KNOWN)).alias("at")).join(F.broadcast(known), "at").select("id", *names)
    t, d, c = (F.col(n) for n in names[:3])
    offers = with_size_bucket(with_resolved(offers, F.lit(None).cast("string"), F.col("base_unit"), d, F.col("face"), "r"), F.col("base_unit"), "bucket")
    vegan = detectors.looks_vegan(t, d)
    return offers.select(
        "id", F.col("r.unit").alias("unit"), F.col("r.value").alias("gp"), "bucket", (detectors.looks_meat(t) & ~vegan).alias("meat"),
        (detectors.looks_fish(t) & ~vegan).alias("fish"), detectors.looks_spirits(t).alias("spirits"), vegan.alias("vegan"),
        digest.diet_excluded(t, d, c, ("meat",)).alias("veto_meat"), digest.diet_excluded(t, d, c, ("fish",)).alias("veto_fish"),
    )


@query("q103_offer_verdicts", f"WITH {KNOWN_SQL} SELECT p_partkey AS id, {', '.join(_VERDICT)} FROM part JOIN k ON pos = p_partkey % {len(KNOWN)}")
def _(spark, sf):
    """Unit price, key and diet verdicts of offers whose verdicts are stated."""
    return _judged(spark, sf)


@query("q104_disagreements", f"WITH {KNOWN_SQL} SELECT p_partkey AS id, 'gp' AS name, CAST(gp::DOUBLE AS VARCHAR) AS \"left\", CAST(gp::DOUBLE + 1 AS VARCHAR) AS \"right\" FROM part JOIN k ON pos = p_partkey % {len(KNOWN)} WHERE p_size = 7 AND gp IS NOT NULL")
def _(spark, sf):
    judged = _judged(spark, sf)
    other = judged.join(table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("id"), F.lit(1.0).alias("off")), "id", "left").withColumn("gp", F.col("gp") + F.coalesce("off", F.lit(0.0))).drop("off")
    return matching.disagreements(judged, other, "id")


SECTIONS = "sections(reply, sections) AS (VALUES (0, ['vegan', 'knueller']), (1, ['vegan', 'obstgemuese', 'bierspezi', 'knueller']), (2, []::VARCHAR[]), (3, ['bierspezi', 'mehr']))"


@query("q105_missing_sections", f"WITH {SECTIONS} SELECT o_orderkey AS reply, array_to_string(list_sort(list_filter(['vegan', 'obstgemuese', 'bierspezi', 'knueller'], lambda x: NOT list_contains(sections, x))), ',') AS missing FROM orders JOIN sections ON reply = o_orderkey % 4 WHERE o_orderkey % 4 <> 1")
def _(spark, sf):
    rows = [(0, ["vegan", "knueller"]), (1, ["vegan", "obstgemuese", "bierspezi", "knueller"]), (2, []), (3, ["bierspezi", "mehr"])]
    given = spark.createDataFrame(rows, "at long, sections array<string>")
    replies = table(spark, sf, "orders").select(F.col("o_orderkey").alias("reply"), (F.col("o_orderkey") % 4).alias("at")).join(F.broadcast(given), "at")
    return digest.missing_sections(replies).select("reply", F.array_join("missing", ",").alias("missing"))


#: Titles by size of a part, so that sections and diets have something to find.
NAMED = """n AS (SELECT id, size, flagged, pctile, best, CASE size % 8 WHEN 0 THEN 'Vegane Bratwurst' WHEN 1 THEN 'Tofu Natur' WHEN 2 THEN 'Radler' WHEN 3 THEN 'Äpfel' WHEN 4 THEN 'Schinkenspeck' WHEN 5 THEN 'Lachsfilet' WHEN 6 THEN 'Spezi Cola' ELSE 'Brot' END AS title,
 CASE size % 8 WHEN 0 THEN 'Fleisch & Wurst' WHEN 2 THEN 'Getränke' WHEN 3 THEN 'Obst & Gemüse' WHEN 4 THEN 'Fleisch & Wurst' ELSE 'Grundnahrung' END AS category FROM o)"""
RANKED = "(PARTITION BY section ORDER BY pctile IS NULL, CASE WHEN best THEN 0 ELSE 1 END, coalesce(pctile, 100), id)"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    o, kind = _offers(spark, sf), F.col("size") % 8
    pick = lambda values, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), kind), F.lit(other))
    titles = {0: "Vegane Bratwurst", 1: "Tofu Natur", 2: "Radler", 3: "Äpfel", 4: "Schinkenspeck", 5: "Lachsfilet", 6: "Spezi Cola"}
    shelves = {0: "Fleisch & Wurst", 2: "Getränke", 3: "Obst & Gemüse", 4: "Fleisch & Wurst"}
    return o.withColumns({"title": pick(titles, "Brot"), "category": pick(shelves, "Grundnahrung"), "description": F.lit("")})


@query("q106_digest_sections", f"""WITH {O}, {NAMED}, s AS (SELECT *, unnest(list_filter([CASE WHEN size % 8 IN (0, 1) THEN 'vegan' END, CASE WHEN size % 8 = 3 THEN 'produce' END, CASE WHEN size % 8 IN (2, 6) THEN 'beer' END, CASE WHEN flagged THEN 'flagged' END], lambda x: x IS NOT NULL)) AS section FROM n WHERE size % 8 NOT IN (4, 5)),
 r AS (SELECT section, id, title, row_number() OVER {RANKED} AS place FROM s) SELECT section, place, id, title FROM r WHERE place <= 18""")  # fmt: skip
def _(spark, sf):
    """The digest with its diet filter: meat and fish are muted, the vegan sausage stays."""
    s = digest.sectioned(_named(spark, sf), ("meat", "fish"))
    return s.select("section", F.col("place").cast("long").alias("place"), "id", "title")


@query("q107_vegan_candidates", f"WITH {O}, {NAMED} SELECT id, title, row_number() OVER (ORDER BY pctile IS NULL, CASE WHEN best THEN 0 ELSE 1 END, coalesce(pctile, 100), id) AS place FROM n WHERE size % 8 IN (0, 1, 3) ORDER BY place LIMIT 40")
def _(spark, sf):
    found = digest.vegan_candidates(_named(spark, sf))
    return found.withColumn("place", F.row_number().over(Window.orderBy(*digest.by_evidence())).cast("long")).select("id", "title", "place")  # forty rows


@query("q108_pruned_votes", f"""WITH {O}, v AS (SELECT event_id, user_id AS id, CASE event_type WHEN 'error' THEN -1 WHEN 'click' THEN 1 END AS v FROM events WHERE event_type IN ('error', 'click'))
 SELECT event_id, id, v FROM v WHERE v <> -1 OR id NOT IN (SELECT id FROM o WHERE category = 'PROMO')""")  # fmt: skip
def _(spark, sf):
    e = table(spark, sf, "events").where("event_type in ('error', 'click')")
    votes = e.select("event_id", F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("v"))
    return personal.pruned_votes(votes, _offers(spark, sf), "PROMO")


@query("q109_basket", f"WITH {O} SELECT event_id, user_id AS id, coalesce(title, 'kept ' || CAST(user_id AS VARCHAR)) AS name, title IS NOT NULL AS offered, price FROM events LEFT JOIN (SELECT * FROM o WHERE size > 10) ON id = user_id WHERE event_type = 'purchase'")
def _(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    kept = e.groupBy(F.col("user_id").alias("id")).agg(F.collect_list("event_id").alias("events")).withColumn("kept_title", F.concat(F.lit("kept "), F.col("id").cast("string")))
    named = matching.basket(kept.select("id", "kept_title"), _offers(spark, sf).where("size > 10"))
    return e.select("event_id", F.col("user_id").alias("id")).join(named, "id").select("event_id", "id", "name", "offered", "price")


MEALS = """raw AS (SELECT o_custkey AS reply, o_orderkey AS pos, 'Meal ' || CAST(o_orderkey % 23 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '!' ELSE '' END AS title, 'red ring' AS a, 'no such offer' AS b FROM orders),
 f AS (SELECT *, row_number() OVER (PARTITION BY reply, replace(title, '!', '') ORDER BY pos) AS again FROM raw), k AS (SELECT *, row_number() OVER (PARTITION BY reply ORDER BY pos) AS place, count(*) OVER (PARTITION BY reply) AS n FROM f WHERE again = 1)"""


@query("q110_meals", f"""WITH {MEALS} SELECT reply, place, title, CASE WHEN place <= 7 THEN 'day' ELSE 'bench' END AS part, CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_name = 'red ring') THEN 'oil>,ring>red ring' ELSE 'oil>,ring>' END AS items FROM k WHERE n >= 7 AND place <= 12""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    title = F.concat(F.lit("Meal "), (F.col("o_orderkey") % 23).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "!").otherwise(""))
    line = lambda name, offer: F.struct(F.lit(name).alias("name"), F.lit(offer).alias("offerTitle"))
    raw = o.select(F.col("o_custkey").alias("reply"), F.col("o_orderkey").alias("pos"), title.alias("title"), F.array(line(" ring ", "red ring"), line("oil", "no such offer")).alias("ingredients"))
    m = digest.meals(raw, _offers(spark, sf))
    items = F.array_join(F.transform("ingredients", lambda i: F.concat(i["name"], F.lit(">"), F.coalesce(i["offerTitle"], F.lit("")))), ",")
    return m.select("reply", F.col("place").cast("long").alias("place"), "title", "part", items.alias("items"))


@query("q111_loyalty", """WITH l AS (SELECT 'Item ' || CAST(l_partkey % 40 AS VARCHAR) AS name, CASE WHEN l_linenumber = 1 THEN 1 ELSE l_quantity END AS qty, CASE WHEN l_linenumber = 2 THEN 0 ELSE l_extendedprice END AS spent FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
 SELECT lower(name) AS norm, count(*) AS c, sum(qty) AS qty, CAST(sum(CAST(floor(spent*100 + 0.5) AS HUGEINT)) AS DOUBLE)/100 AS spent, max(name) AS name FROM l GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    """Receipt lines by item; every seventh order also has a line that is no product."""
    j = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    qty = F.when(F.col("l_linenumber") == 1, -1.0).otherwise(F.col("l_quantity"))
    spent = F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice"))
    lines = j.select(F.concat(F.lit("Item "), (F.col("l_partkey") % 40).cast("string")).alias("name"), qty.alias("qty"), spent.alias("spent"), F.col("o_orderdate").alias("at"))
    sums = table(spark, sf, "orders").where("o_orderkey % 7 = 0").select(F.lit("Zwischensumme").alias("name"), F.lit(1.0).alias("qty"), F.col("o_totalprice").alias("spent"), F.col("o_orderdate").alias("at"))
    return personal.loyalty(lines.unionByName(sums).withColumn("norm", text.norm_title(F.col("name"))))


@query("q112_visible_rows", """SELECT '{"title":"' || p_name || '","category":"' || p_type || '","price":' || CAST(p_retailprice AS VARCHAR) || ',"basic_price":"1 kg = € ' || CAST(p_size AS VARCHAR) || '","flagged":' || CASE WHEN p_size % 5 = 0 THEN 'true' ELSE 'false' END || ',"description":"' || p_brand || '"}' AS value FROM part WHERE p_size > 25""")
def _(spark, sf):
    o = _offers(spark, sf).withColumn("basic_price", F.concat(F.lit("1 kg = € "), F.col("size").cast("string")))
    return sinks.visible_rows(o, F.col("size") > 25)


@query("q113_weeks_offered", f"""WITH {OBS}, w AS (SELECT DISTINCT d FROM obs), k AS (SELECT key, count(DISTINCT d) AS weeks, min(d) AS first_d, max(d) AS last_d FROM obs GROUP BY key), a AS (SELECT d AS last_d, row_number() OVER (ORDER BY d DESC) - 1 AS since FROM w)
 SELECT key, weeks, first_d, last_d, since FROM k JOIN a USING (last_d)""")  # fmt: skip
def _(spark, sf):
    return history.weeks_offered(observations(spark, sf)).select("key", "weeks", "first_d", "last_d", "since")


@query("q114_interest_levels", """WITH u AS (SELECT * FROM (VALUES ('vegan', 2), ('beer', 1), ('fish', -1), ('drugstore', 0)) v(topic, usual)), s AS (SELECT p_brand AS topic, max(p_size % 6 - 2) AS level FROM part GROUP BY p_brand UNION ALL SELECT 'beer', 2 UNION ALL SELECT 'fish', 9)
 SELECT coalesce(u.topic, s.topic) AS topic, coalesce(CASE WHEN level IN (-1, 0, 1, 2) THEN level END, usual) AS level FROM u FULL JOIN s ON u.topic = s.topic WHERE usual IS NOT NULL OR level IN (-1, 0, 1, 2)""")  # fmt: skip
def _(spark, sf):
    stored = table(spark, sf, "part").groupBy(F.col("p_brand").alias("topic")).agg(F.max(F.col("p_size") % 6 - 2).alias("level"))
    stored = stored.unionByName(spark.createDataFrame([("beer", 2), ("fish", 9)], "topic string, level int"))
    return digest.effective_levels({"vegan": 2, "beer": 1, "fish": -1, "drugstore": 0}, stored)


@query("q115_shown_values", """SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'quoted' WHEN 1 THEN '≈ 1 kg = € ' || printf('%.2f', floor(p_retailprice/(p_size*0.1)*100 + 0.5)/100) ELSE '' END AS unit_price, CASE WHEN p_size % 2 = 0 THEN 'HTTPS://x/' || CAST(p_partkey AS VARCHAR) END AS url,
 CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size + 0.5 END AS number, CASE WHEN p_size > 30 THEN repeat('x', 89) || '…' ELSE repeat('x', 3*p_size) END AS reason, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS price, CASE WHEN p_size % 7 = 0 THEN p_retailprice END AS price_max, p_size % 3 <> 1 AS fresh FROM part""")  # fmt: skip
def _(spark, sf):
    """The small projections of an offer: unit price as shown, safe link, numbers from text, short reason, deal prices, freshness."""
    p, size, price = table(spark, sf, "part"), F.col("p_size"), F.col("p_retailprice")
    quoted = F.when(size % 3 == 0, " quoted ")
    base = F.when(size % 3 == 1, F.concat((size * 100).cast("string"), F.lit(" g")))
    url = F.concat(F.when(size % 2 == 0, "HTTPS://x/").otherwise("javascript:"), F.col("p_partkey").cast("string"))
    number = F.when(size % 4 == 0, "NaN").otherwise(F.concat(F.lit(" "), size.cast("string"), F.lit(",5")))
    deal = lambda kind, low, high: F.struct(F.lit(kind).alias("type"), low.alias("min"), high.alias("max"))
    least = F.when(size % 7 == 0, 0.0).otherwise(price)
    deals = F.array(deal("OTHER", F.lit(1.0), F.lit(2.0)), deal("SALES_PRICE", least, price))
    week = F.when(size % 3 == 0, "KW1").when(size % 3 == 1, "KW2").otherwise("")
    shown = scalars.deal_prices(deals)
    p = with_resolved(p, quoted, base, F.lit(None).cast("string"), price, "r")
    return p.select(
        F.col("p_partkey").alias("id"), scalars.shown_unit_price(quoted, F.col("r")).alias("unit_price"), scalars.safe_url(url).alias("url"),
        scalars.finite(number, comma=True).alias("number"), scalars.shortened(F.expr("repeat('x', 3 * p_size)")).alias("reason"), shown["price"].alias("price"), shown["price_max"].alias("price_max"),
        scalars.fresh(week, F.lit("KW1")).alias("fresh"),
    )


@query("q116_receipt_fingerprints", "SELECT count(*) AS n, count(DISTINCT (o_custkey, o_orderdate)) AS same FROM orders")
def _(spark, sf):
    """Receipts fall together by fingerprint whatever the order of their lines and the case of their names."""
    o = table(spark, sf, "orders")
    line = lambda name, price: F.struct(name.alias("name"), F.lit(1.0).alias("qty"), F.lit(price).alias("price"))
    a, b = line(F.lit("Milch"), 1.0), line(F.concat(F.lit("Brot "), F.col("o_custkey").cast("string")), 2.0)
    turned = F.when(F.col("o_orderkey") % 2 == 0, F.array(a, b)).otherwise(F.array(line(F.concat(F.lit("BROT "), F.col("o_custkey").cast("string")), 2.0), a))
    fp = scalars.receipt_fingerprint(F.when(F.col("o_orderkey") % 3 == 0, "Shop").otherwise(" shop"), F.col("o_orderdate").cast("string"), turned)
    return o.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(fp).alias("same"))


@query("q117_unseen_receipts", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 3)")
def _(spark, sf):
    fp = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256).alias("fp")
    ledger = table(spark, sf, "lineitem").where("l_linenumber <= 3").select(fp("l_orderkey"))
    return ingest.fresh_only(table(spark, sf, "orders").select("o_orderkey", fp("o_orderkey")), ledger, "fp").select("o_orderkey")


@query("q118_preference_summary", """WITH i AS (SELECT o_custkey AS "user", o_orderpriority AS topic, CAST(max(o_orderkey % 4 - 1) AS INT) AS level FROM orders GROUP BY 1, 2)
 SELECT "user", coalesce(string_agg(topic, ', ' ORDER BY topic) FILTER (level = 2), '') AS loves, coalesce(string_agg(topic, ', ' ORDER BY topic) FILTER (level = 1), '') AS likes, coalesce(string_agg(topic, ', ' ORDER BY topic) FILTER (level = -1), '') AS off FROM i GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    levels = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user"), F.col("o_orderpriority").alias("topic")).agg(F.max(F.col("o_orderkey") % 4 - 1).cast("int").alias("level"))
    return digest.preference_summary(levels)


@query("q119_reply_json", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS id FROM orders""")
def _(spark, sf):
    """JSON from replies: bare, fenced, behind an example that is no receipt, and broken."""
    key = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit('{"items": [{"name": "x"}], "id": '), key, F.lit("}"))
    kind = F.col("o_orderkey") % 4
    reply = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit('Here {"echo": 1} it is: '), body, F.lit(" bye"))).otherwise("{ nothing")
    return table(spark, sf, "orders").select("o_orderkey", F.try_variant_get(scalars.reply_json(reply, prefer="items"), "$.id", "string").alias("id"))


#: Offers whose topics are known: title, description, category, flagged, topics in order.
TOPICAL = (
    ("Landbier", "", "Getränke", False, "beer,drinks"),
    ("Kellerbier-Senf", "", "Grundnahrung", False, "staples"),
    ("Spezi Cola-Mix", "", "Getränke", False, "drinks,spezi"),
    ("Fischspezialitäten", "", "Fisch & Meeresfrüchte", False, "fish"),
    ("Lavazza Espresso", "ganze Bohne", "Getränke", True, "coffee,drinks,flagged"),
    ("prodomo", "gemahlener Bohnenkaffee", "Grundnahrung", False, "coffee,staples"),
    ("Bio Gouda", "", "Molkerei & Käse", False, "cheese,organic"),
    ("Biografie", "", "Drogerie", False, "drugstore"),
    ("veggie Würstchen", "", "Fleisch & Wurst", False, ""),
    ("Vegane Bratwurst", "", "Fleisch & Wurst", True, "flagged,vegan"),
    ("Aufschnitt", "", "Fleisch & Wurst", False, "meat"),
    ("Limetten", "", "Obst & Gemüse", False, "produce"),
    ("Rumänischer Rotwein", "", "Getränke", False, "drinks,spirits"),
    ("Schokolade", "", "Knabbern & Naschen", False, "sweets"),
    ("Räucherlachs", "", "Tiefkühl", False, "fish,frozen"),
    ("Hühnerfutter", "", "Tiernahrung", False, "meat,pets"),
    (None, None, None, None, ""),
)
TOPICAL_SQL = "k AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{row[4]}')" for i, row in enumerate(TOPICAL)) + ") v(pos, topics))"


@query("q120_topics", f"WITH {TOPICAL_SQL} SELECT p_partkey AS id, topics FROM part JOIN k ON pos = p_partkey % {len(TOPICAL)}")
def _(spark, sf):
    """All topics of offers whose topics are stated."""
    known = spark.createDataFrame([(i, *row[:4]) for i, row in enumerate(TOPICAL)], "at long, title string, description string, category string, flagged boolean")
    o = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % len(TOPICAL)).alias("at")).join(F.broadcast(known), "at")
    hits = [F.when(detectors.topic(name, F.col("title"), F.col("description"), F.col("category"), F.col("flagged")), name) for name in sorted(detectors.TOPICS)]
    return o.select("id", F.array_join(F.array_compact(F.array(*hits)), ",").alias("topics"))
