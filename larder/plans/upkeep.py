"""Queries over what is kept between runs (indexes, postings, sketches, states) and over German order, next to their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.unitprice import face_price
from ..operators import digest, history, matching, personal, postings, selection, sketch
from ..sources import files, sinks, versions
from ..sources.tables import observations, preferences, table
from ..streaming import ingest, product_index, watch
from .archive import FOLD, OBS, STATS, UML, _weekly, query
from .selections import HAY, O, _offers


def _last_week(line: DataFrame, obs: DataFrame) -> date | None:
    """The last week with an observation; of all lines only those of the last days are joined, if these have one."""
    week = F.date_trunc("week", "l_shipdate").cast("date")
    top = line.agg(F.max(week).alias("d")).first().d
    last = obs.where(F.col("d") >= F.date_sub(F.lit(top), 14)).agg(F.max("d").alias("d")).first().d
    return last or obs.agg(F.max("d").alias("d")).first().d


@query("q121_incremental_index", f"""WITH {OBS}, w AS (SELECT key, d, min(gp) AS gp FROM obs WHERE gpf IS NULL GROUP BY key, d),
 e AS (SELECT key, min(gp) AS low, max(gp) AS high, arg_max(gp, d) AS latest, max(d) AS latest_d FROM w GROUP BY key),
 o AS (SELECT key, arg_max(title, (d, l_orderkey, l_linenumber)) AS title, arg_max(cat, (d, l_orderkey, l_linenumber)) AS cat, max(unit) AS unit, count(DISTINCT d) AS weeks, count(*) AS n_obs, min(d) AS first_d, max(d) AS last_d FROM obs GROUP BY key)
 SELECT key, title, cat, unit, weeks, n_obs, low, high, latest, latest_d, first_d, last_d FROM o LEFT JOIN e USING (key) WHERE weeks >= 2""")  # fmt: skip
def _(spark, sf):
    """The product index of all weeks, made of the archive up to a date and then brought up to date by the rest."""
    obs, folder = observations(spark, sf), sinks.shared_folder(spark, "product-index")
    late = F.col("d") >= F.date_sub(F.lit(_last_week(table(spark, sf, "lineitem"), obs)), 14)
    put = lambda rows: rows.repartition("d").write.mode("append").partitionBy("d").parquet(f"{folder}/archive")
    index = product_index.ProductIndex(spark, f"{folder}/archive", f"{folder}/index")
    for part in (obs.where(~late), obs.where(late)):
        put(part)
        index.update()
    return index.products()


@query("q122_gated_digest", f"WITH {STATS}, l AS (SELECT max(d) AS d FROM obs) SELECT key, latest, low, CAST(isoyear(l.d) AS VARCHAR) || '-KW' || lpad(CAST(week(l.d) AS VARCHAR), 2, '0') AS week FROM stats, l WHERE latest_d = l.d")
def _(spark, sf):
    """The latest week's products, built once: the second call finds its label and builds nothing."""
    path, obs = sinks.shared_folder(spark, "gated-digest"), observations(spark, sf)
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("d")).cast("string"), F.lit("-KW"), F.lpad(F.weekofyear("d").cast("string"), 2, "0"))
    top = obs.agg(F.max("d").alias("d")).select("d", week.alias("week")).first()

    def build() -> DataFrame:
        now = history.product_stats(_weekly(spark, sf)).where(F.col("latest_d") == F.lit(top.d))
        return now.select("key", "latest", "low", F.lit(top.week).alias("week"))

    built = [ingest.rebuilt_when_stale(spark, path, top.week, build) for _ in range(2)]
    if built != [True, False]:
        raise AssertionError(f"built {built}")
    return versions.read(spark, path, "rows")


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct words of all documents, without marks at their edges."""
    d = table(spark, sf, "documents").where("lang in ('de', 'fr')")
    words = d.select(F.explode(F.split("text", r"[\x09-\x0D ]+")).alias("w")).select(F.regexp_replace("w", r"^[^\p{L}]+|[^\p{L}]+$", "").alias("word"))
    return words.where("word <> ''").distinct()


WORDS = r"""w AS (SELECT DISTINCT regexp_replace(x, '^[^\p{L}]+|[^\p{L}]+$', '', 'g') AS word FROM (SELECT unnest(regexp_split_to_array(text, '[\x09-\x0D ]+')) AS x FROM documents WHERE lang IN ('de', 'fr')) WHERE x <> '')"""


@query("q123_german_order", f"WITH {WORDS}, g AS (SELECT word, substr(strip_accents(lower(word)), 1, 1) AS grp FROM w WHERE word <> '') SELECT grp, word, row_number() OVER (PARTITION BY grp ORDER BY word COLLATE de, word) AS place FROM g")
def _(spark, sf):
    """The words of each initial letter in German order: umlauts beside their vowels."""
    initial = F.substring(F.translate(F.lower("word"), text.ACCENTED, text.PLAIN), 1, 1)
    w = _words(spark, sf).withColumn("grp", initial)
    return w.select("grp", "word", F.row_number().over(Window.partitionBy("grp").orderBy(text.german(F.col("word")), "word")).cast("long").alias("place"))


TITLED = r"t AS (SELECT doc_id AS id, lang, length(text) % 3 = 0 AS hidden, CASE WHEN doc_id % 7 = 0 THEN '' ELSE regexp_extract(text, '[\p{L} ]{1,40}') END AS title, doc_id % 5 AS score FROM documents WHERE text IS NOT NULL)"


def _titled(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    title = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.regexp_extract("text", r"[\p{L} ]{1,40}", 0))
    return d.select(F.col("doc_id").alias("id"), "lang", (F.char_length("text") % 3 == 0).alias("hidden"), title.alias("title"), (F.col("doc_id") % 5).alias("score"))


@query("q124_table_order_german", f"WITH {TITLED} SELECT id, lang, title, row_number() OVER (PARTITION BY lang ORDER BY title = '', lower(title) COLLATE de DESC, title DESC, id) AS place FROM t")
def _(spark, sf):
    """The title column of each language's table, descending, what has no title last all the same."""
    order = Window.partitionBy("lang").orderBy(*selection.table_order("title", up=False), "id")
    return _titled(spark, sf).select("id", "lang", "title", F.row_number().over(order).cast("long").alias("place"))


@query("q125_best_of_german", f"WITH {TITLED} SELECT id, title, score FROM t WHERE score > 0 ORDER BY score DESC, title COLLATE de, title, id LIMIT 16")
def _(spark, sf):
    return personal.best_of(_titled(spark, sf), 16).select("id", "title", "score")


DELIVERED = "h AS (SELECT o_orderpriority AS source, CAST(date_trunc('week', o_orderdate) AS DATE) AS d, count(*) AS n, md5(CAST(count(*) AS VARCHAR)) AS hash FROM orders GROUP BY 1, 2)"


def _delivered(spark: SparkSession, sf: str) -> DataFrame:
    """A delivery a priority and week, told apart by its number of orders alone."""
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.date_trunc("week", "o_orderdate").cast("date").alias("d"))
    return o.agg(F.count(F.lit(1)).alias("n")).withColumn("hash", F.md5(F.col("n").cast("string").cast("binary")))


@query("q126_stale_weeks", f"WITH {DELIVERED} SELECT a.source, a.d FROM h a JOIN h b ON a.source = b.source AND a.d = b.d + 7 AND a.hash = b.hash")
def _(spark, sf):
    return watch.stale_weeks(_delivered(spark, sf))


@query("q127_delivery_verdicts_stream", f"""WITH RECURSIVE {DELIVERED}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d) AS i FROM h),
 r AS (SELECT source, d, n, hash, i, 'stored' AS verdict FROM n WHERE i = 1
  UNION ALL SELECT n.source, n.d, n.n, n.hash, n.i, CASE WHEN r.verdict = 'stored' AND n.d = r.d + 7 AND n.hash = r.hash THEN 'stale' ELSE 'stored' END FROM r JOIN n ON n.source = r.source AND n.i = r.i + 1)
 SELECT source, d, n, verdict FROM r""")  # fmt: skip
def _(spark, sf):
    """Verdicts by state: what was stale was not stored, so that a third equal week counts as new again."""
    folder = sinks.shared_folder(spark, "deliveries")
    rows = _delivered(spark, sf)
    rows.write.parquet(f"{folder}/in")
    with watch.keyed_state(spark):
        stream = watch.judged(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        ingest.ingest(stream, lambda batch, epoch: batch.write.mode("append").parquet(f"{folder}/out"), f"{folder}/state", "update")
    return spark.read.schema(watch.VERDICTS).parquet(f"{folder}/out")


SEEN = """s AS (SELECT event_type AS source, ts AS seen_at, CASE WHEN event_id % 211 = 0 THEN CAST(date_trunc('week', ts) AS DATE) END AS d, CAST(date_trunc('week', ts) AS DATE) AS week FROM events)"""


@query("q128_missing_week_alerts_stream", f"""WITH {SEEN}, top AS (SELECT max(seen_at) AS top FROM s) SELECT source, week, CAST(week + 1 AS TIMESTAMP) AS due FROM s, top
 GROUP BY source, week, top HAVING count(*) FILTER (d IS NOT NULL AND seen_at < CAST(week + 1 AS TIMESTAMP)) = 0 AND CAST(week + 1 AS TIMESTAMP) <= top""")  # fmt: skip
def _(spark, sf):
    """One alert a source and week for which nothing was delivered before its Tuesday."""
    folder = sinks.shared_folder(spark, "alerts")
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_id") % 211 == 0, F.date_trunc("week", "ts").cast("date")).alias("d"))
    e.write.parquet(f"{folder}/in")
    with watch.keyed_state(spark):
        stream = watch.alerts(spark.readStream.schema(e.schema).parquet(f"{folder}/in"))
        ingest.ingest(stream, lambda batch, epoch: batch.write.mode("append").parquet(f"{folder}/out"), f"{folder}/state")
    return spark.read.schema(watch.ALERTS).parquet(f"{folder}/out").withColumn("due", F.col("due").cast("timestamp_ntz"))


def _document_postings(spark: SparkSession, sf: str, fold) -> tuple[postings.Postings, DataFrame]:
    """An index of the folded texts, and the documents (id, lang, text), of which a search folds the candidates alone."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    index = postings.Postings(spark, sinks.shared_folder(spark, "postings"))
    index.write(d.select("id", fold(F.col("text")).alias("hay")))
    return index, d


@query("q129_indexed_token_search", f"SELECT doc_id FROM documents WHERE contains({FOLD}, 'tion') AND contains({FOLD}, 'le') AND contains({FOLD}, 'eau')")
def _(spark, sf):
    """The search of q56 by postings."""
    index, d = _document_postings(spark, sf, text.search_fold)
    hits = text.once(d.join(index.candidates(["tion", "le", "eau"]), "id", "left_semi"), "hay", text.search_fold(F.col("text")))
    return hits.where(selection.all_tokens(F.col("hay"), "tion le eau", {})).select(F.col("id").alias("doc_id"))


@query("q130_indexed_umlaut_search", f"SELECT lang, count(*) AS n FROM documents WHERE contains({UML}, 'ueber') OR contains({UML}, 'oe') GROUP BY lang")
def _(spark, sf):
    """The search of q57 by postings: either term."""
    index, d = _document_postings(spark, sf, text.fold_umlauts)
    found = postings.any_of([index.candidates([t]) for t in ("ueber", "oe")])
    hits = text.once(d.join(found, "id", "left_semi"), "hay", text.fold_umlauts(F.col("text")))
    return hits.where(F.contains("hay", F.lit("ueber")) | F.contains("hay", F.lit("oe"))).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("q131_indexed_topic_search", f"WITH {O} SELECT id FROM o WHERE contains({HAY}, 'brand') AND (contains({HAY}, 'gadg') OR category = 'ECONOMY') AND contains({HAY}, 'co')")
def _(spark, sf):
    """The search of q82 by postings, topics among them."""
    o, hay = _offers(spark, sf), text.search_fold(F.concat_ws(" ", "title", "category", "description"))
    topics = {"Gadgets & Co": F.col("category") == "ECONOMY", "Metall": F.col("title").contains("steel")}
    folded = {label: text.decomposed(label) for label in topics}
    members = o.select("id", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(folded[label])) for label, test in topics.items()]))).alias("label"))
    index = postings.Postings(spark, sinks.shared_folder(spark, "postings"))
    index.write(o.select("id", hay.alias("hay")), members)
    asked = "Bránd  gadg co"
    found = index.candidates(text.decomposed(asked).split(), list(folded.values()), selection.TOPIC_TOKEN)
    return text.once(o.join(found, "id", "left_semi"), "hay", hay).where(selection.all_tokens(F.col("hay"), asked, topics)).select("id")


@query("q132_indexed_title_search", f"WITH {O} SELECT id, title FROM o WHERE contains(lower(title), 'ring') OR contains(lower(description), 'ring') ORDER BY title, id LIMIT 50")
def _(spark, sf):
    o = _offers(spark, sf)
    index = postings.Postings(spark, sinks.shared_folder(spark, "postings"))
    index.write(o.select("id", text.search_fold(F.concat_ws(" ", "title", "description")).alias("hay")))
    return selection.title_or_description(o.join(index.candidates(["ring"]), "id", "left_semi"), "Ring").select("id", "title")


#: Folders that the files of suppliers are dealt to.
FOLDERS = 64
ARCHIVED = OBS + ", there AS (SELECT DISTINCT supp FROM obs WHERE supp % 3 <> 0)"


def _archived(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Offers by supplier, and a file for two of three suppliers and for ten that offer nothing.

    Offers are joined and written once, the suppliers next; tasks write the files into ``FOLDERS`` folders, and list these.
    """
    folder = sinks.shared_folder(spark, "images")
    observations(spark, sf).select("d", "supp").write.parquet(f"{folder}/offers")
    offers = spark.read.parquet(f"{folder}/offers")
    offers.select("supp").distinct().write.parquet(f"{folder}/suppliers")
    seen = spark.read.parquet(f"{folder}/suppliers")
    kept = seen.where("supp % 3 <> 0").unionByName(seen.orderBy("supp").limit(10).select((-F.col("supp") - 1).alias("supp")))
    path = F.format_string("%02d/%d.img", F.pmod(F.col("supp"), F.lit(FOLDERS)), F.col("supp"))
    files.store(kept.select(path.alias("path"), F.lit("x").alias("content")).repartition(FOLDERS, "path"), f"{folder}/files")
    found = files.listed(spark.range(0, FOLDERS, 1, FOLDERS).select(F.format_string(f"{folder.replace('%', '%%')}/files/%02d", "id").alias("folder")), r"([^/]+)\.img$")
    return offers.select("d", F.col("supp").cast("string").alias("id")), found


@query("q133_archived_files_by_week", f"WITH {ARCHIVED} SELECT d, count(*) FILTER (supp IN (SELECT supp FROM there)) AS have, count(*) AS total FROM obs GROUP BY d")
def _(spark, sf):
    return files.by_week(*_archived(spark, sf))


@query("q134_missing_and_orphaned_files", f"WITH {ARCHIVED} SELECT 'missing' AS what, CAST(supp AS VARCHAR) AS id FROM (SELECT DISTINCT supp FROM obs WHERE supp NOT IN (SELECT supp FROM there)) UNION ALL SELECT 'orphaned', CAST(-supp - 1 AS VARCHAR) FROM (SELECT DISTINCT supp FROM obs ORDER BY supp LIMIT 10)")
def _(spark, sf):
    offers, found = _archived(spark, sf)
    lost = files.orphaned(offers, found).select(F.lit("orphaned").alias("what"), F.col("name").alias("id"))
    return files.missing(offers, found).select(F.lit("missing").alias("what"), "id").unionByName(lost)


@query("q135_sketched_medians", f"WITH {OBS} SELECT cat, count(*) AS n, min(face) AS low, true AS within FROM obs GROUP BY cat")
def _(spark, sf):
    """Category medians from stored weekly sketches: each is within the stated rank error of the exact one."""
    obs, folder = observations(spark, sf), sinks.shared_folder(spark, "sketches")
    sketch.weekly_sketches(obs, "face", "cat").repartition("d").write.partitionBy("d").parquet(folder)
    found = sketch.quantiles(spark.read.parquet(folder), "cat", at=(0.5, 0.0))
    return sketch.rank_errors(obs, found, "face", "cat").select("cat", "n", F.col("q1").alias("low"), (F.col("error") <= sketch.RANK_ERROR).alias("within"))


@query("q136_search_fold_exact", f"SELECT doc_id, md5({FOLD}) AS folded FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.exact_fold(F.col("text")).cast("binary")).alias("folded"))


@query("q137_merged_shopping_list", """WITH r AS (SELECT p_brand || CASE WHEN p_size % 2 = 0 THEN ' ' ELSE '' END AS name, CASE WHEN p_size % 3 = 0 THEN 'offer' ELSE 'pantry' END AS grp, 'plan' AS source FROM part WHERE p_size <= 20
 UNION ALL SELECT upper(p_type), 'offer', 'basket' FROM part WHERE p_size BETWEEN 15 AND 30 UNION ALL SELECT p_type, 'custom', 'own' FROM part WHERE p_size > 25 UNION ALL SELECT p_brand, 'custom', 'own' FROM part WHERE p_size > 45),
 n AS (SELECT lower(trim(name)) AS norm, trim(name) AS name, grp, source, CASE grp WHEN 'offer' THEN 0 WHEN 'custom' THEN 1 ELSE 2 END AS rank FROM r)
 SELECT norm, arg_min(name, (rank, name)) AS name, arg_min(grp, (rank, name)) AS grp, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM n WHERE norm NOT IN (SELECT DISTINCT lower(p_type) FROM part WHERE p_type LIKE 'PROMO%') GROUP BY norm""")  # fmt: skip
def _(spark, sf):
    p = table(spark, sf, "part")
    spelt = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, " ").otherwise(""))
    plan = p.where("p_size <= 20").select(spelt.alias("name"), F.when(F.col("p_size") % 3 == 0, "offer").otherwise("pantry").alias("grp"))
    basket, own = p.where("p_size between 15 and 30").select(F.upper("p_type").alias("name")), p.where("p_size > 25").select(F.col("p_type").alias("name"))
    own = own.unionByName(p.where("p_size > 45").select(F.col("p_brand").alias("name")))
    merged = personal.merged_list(plan, basket, own, p.where("p_type like 'PROMO%'").select(F.col("p_type").alias("name")))
    return merged.select("norm", F.trim("name").alias("name"), "grp", F.array_join("sources", "+").alias("sources"))


@query("q138_receipts_by_title", """WITH i AS (SELECT lower(trim(c_mktsegment)) || ' ' || CAST(c_custkey % 40 AS VARCHAR) AS norm, count(*) AS c FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1),
 o AS (SELECT c_custkey AS id, ' ' || upper(c_mktsegment) || '  ' || CAST(c_nationkey AS VARCHAR) AS title FROM customer)
 SELECT id, title, coalesce(c, 0) AS c FROM o LEFT JOIN i ON norm = regexp_replace(lower(trim(title)), '\\s+', ' ', 'g')""")  # fmt: skip
def _(spark, sf):
    """Offers with the purchases of their title, in whatever spelling the receipts have it."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    name = F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 40).cast("string"))
    lines = c.join(o, F.col("c_custkey") == F.col("o_custkey")).select(name.alias("name"), text.norm_title(name).alias("norm"), F.lit(1.0).alias("qty"), F.col("o_totalprice").alias("spent"), F.col("o_orderkey").alias("at"))
    offers = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), F.upper("c_mktsegment"), F.lit("  "), F.col("c_nationkey").cast("string")).alias("title"))
    return personal.bought_offers(offers, personal.loyalty(lines))


@query("q139_typeahead_groups", f"""WITH {OBS}, p AS (SELECT key, any_value(title) AS title, CASE WHEN part % 9 = 0 THEN '—' ELSE any_value(cat) END AS grp, count(DISTINCT d) AS weeks FROM obs GROUP BY key, part)
 SELECT grp, key, title, row_number() OVER (PARTITION BY grp ORDER BY weeks DESC, title, key) AS place FROM p WHERE contains(lower(title || ' ' || CASE WHEN grp = '—' THEN '' ELSE grp END), 'ring')""")  # fmt: skip
def _(spark, sf):
    o = observations(spark, sf).groupBy("key", "part", "title", "cat").agg(F.count_distinct("d").alias("weeks"))
    products = o.withColumn("cat", F.when(F.col("part") % 9 != 0, F.col("cat")))
    return selection.typeahead(products, "RING").select("grp", "key", "title", F.col("place").cast("long").alias("place"))


@query("q140_taste_summary", """WITH i AS (SELECT o_custkey AS "user", o_orderpriority AS topic, CAST(max(o_orderkey) % 4 - 1 AS INT) AS level FROM orders GROUP BY 1, 2),
 v AS (SELECT user_id AS "user", event_type AS title, CASE WHEN sum(value) > count(*) * 0.5 THEN 1 ELSE -1 END AS v FROM events GROUP BY 1, 2),
 b AS (SELECT "user", name, c, row_number() OVER (PARTITION BY "user" ORDER BY c DESC, name) AS place FROM (SELECT o_custkey AS "user", o_orderstatus AS name, count(*) AS c FROM orders GROUP BY 1, 2)),
 a AS (SELECT "user", string_agg(topic, ', ' ORDER BY topic) FILTER (level = 2) AS loves, string_agg(topic, ', ' ORDER BY topic) FILTER (level = 1) AS likes, string_agg(topic, ', ' ORDER BY topic) FILTER (level = -1) AS off FROM i GROUP BY 1),
 t AS (SELECT "user", string_agg(title, ', ' ORDER BY title) FILTER (v = 1) AS up, string_agg(title, ', ' ORDER BY title) FILTER (v = -1) AS down FROM v GROUP BY 1),
 l AS (SELECT "user", string_agg(name || ' ×' || CAST(c AS VARCHAR), ', ' ORDER BY place) AS loyal FROM b WHERE place <= 2 GROUP BY 1)
 SELECT "user", coalesce(loves, '') AS loves, coalesce(likes, '') AS likes, coalesce(off, '') AS off, coalesce(up, '') AS up, coalesce(down, '') AS down, coalesce(loyal, '') AS loyal FROM a FULL JOIN t USING ("user") FULL JOIN l USING ("user")""")  # fmt: skip
def _(spark, sf):
    o, e = table(spark, sf, "orders"), table(spark, sf, "events")
    i = o.groupBy(F.col("o_custkey").alias("user"), F.col("o_orderpriority").alias("topic")).agg((F.max("o_orderkey") % 4 - 1).cast("int").alias("level"))
    v = e.groupBy(F.col("user_id").alias("user"), F.col("event_type").alias("title")).agg(F.when(F.sum("value") > F.count(F.lit(1)) * 0.5, 1).otherwise(-1).alias("v"))
    b = o.groupBy(F.col("o_custkey").alias("user"), F.col("o_orderstatus").alias("name")).agg(F.count(F.lit(1)).alias("c"))
    return digest.taste_summary(i, v, b, 2)


@query("q141_preferences_repaired", """WITH p AS (SELECT user_id, max(event_id) AS m FROM events GROUP BY 1) SELECT user_id, CASE WHEN m % 5 IN (0, 1, 2) THEN m % 5 END AS level, CASE WHEN m % 3 - 1 IN (-1, 1) THEN m % 3 - 1 END AS vote, m % 4 = 1 AS gluten_free FROM p WHERE m % 11 <> 0
 UNION ALL SELECT user_id, NULL, NULL, false FROM p WHERE m % 11 = 0""")  # fmt: skip
def _(spark, sf):
    """Preferences of each user as stored text: levels and votes out of range are dropped, broken text gives defaults."""
    p = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("m"))
    whole = F.format_string('{"interests":{"a":%d},"votes":{"x":{"v":%d,"t":"t"}},"glutenFree":%s}', F.col("m") % 5, F.col("m") % 3 - 1, F.when(F.col("m") % 4 == 1, "true").otherwise("false"))
    stored = p.select("user_id", F.when(F.col("m") % 11 == 0, "{").otherwise(whole).alias("value"))
    read = preferences(stored, "value", "user_id")
    return read.select("user_id", F.try_element_at("interests", F.lit("a")).cast("long").alias("level"), F.try_element_at("votes", F.lit("x"))["v"].cast("long").alias("vote"), "gluten_free")


@query("q142_marked_titles", """WITH t AS (SELECT min(p_name) AS title, lower(p_name) AS k FROM part GROUP BY 2), m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'nothing' ELSE upper(p_name) END AS raw FROM orders JOIN part ON p_partkey = o_orderkey % 100 + 1)
 SELECT id, raw, title, 'so' AS label FROM m LEFT JOIN t ON k = lower(raw)""")  # fmt: skip
def _(spark, sf):
    p, o = table(spark, sf, "part").select("p_partkey", "p_name"), table(spark, sf, "orders").select("o_orderkey")
    named = o.join(p, F.col("p_partkey") == F.col("o_orderkey") % 100 + 1)
    raw = F.when(F.col("o_orderkey") % 4 == 0, "nothing").otherwise(F.upper("p_name"))
    texts = named.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("x [[ "), raw, F.lit("| so ]] y")).alias("t"))
    return matching.marked_links(texts, p.select(F.col("p_name").alias("title")), "id", "t").select("id", "raw", "title", "label")


@query("q143_face_prices", """SELECT p_partkey, CASE WHEN f BETWEEN 0 AND 500 THEN floor(f*100 + 0.5)/100 END AS face FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_retailprice/3 WHEN 1 THEN 0.0 WHEN 2 THEN p_size + 0.5 END AS f FROM part)""")
def _(spark, sf):
    """The raw number, 0 too, else the text if it is a number; beyond the ceiling, and for other text, none."""
    form = F.col("p_size") % 4
    raw = F.when(form == 0, F.col("p_retailprice") / 3).when(form == 1, F.lit(0.0))
    shown = F.when(form == 2, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).when(form == 1, "7").otherwise("n/a")
    return table(spark, sf, "part").select("p_partkey", face_price(raw, shown).alias("face"))


@query("q144_digest_metadata", """SELECT '{"title":"' || p_name || '","week":"KW01","rank":' || CAST(p_size AS VARCHAR) || '}' AS value FROM part""")
def _(spark, sf):
    """A reply's rows as JSON, in which the week is ours, whatever the reply says."""
    replies = table(spark, sf, "part").select(F.col("p_name").alias("title"), F.lit("claimed").alias("week"), "p_size")
    return sinks.as_json(replies, ["title", "week"], week=F.lit("KW01"), rank=F.col("p_size"))


@query("q145_meal_ingredients", """WITH o AS (SELECT p_name AS title, min(p_partkey) AS offer FROM part WHERE p_size < 10 GROUP BY 1)
 SELECT p_partkey AS meal, p_brand AS name, CASE WHEN p_size % 2 = 0 THEN 'offer' ELSE 'pantry' END AS grp, offer FROM part LEFT JOIN o ON p_size % 2 = 0 AND o.title = p_name""")  # fmt: skip
def _(spark, sf):
    p = table(spark, sf, "part")
    lines = p.select(F.col("p_partkey").alias("meal"), F.col("p_brand").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("offer_title"))
    return matching.ingredients(lines, p.where("p_size < 10").select(F.col("p_name").alias("title"), F.col("p_partkey").alias("id")))
