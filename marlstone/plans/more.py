"""Further queries over the test tables: imports, accounts, schedules, labels, evaluation; each runs a library function."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import access, dml, evals, imports, jobs
from . import api, generate, views
from .queries import OBSERVED_SQL, POINT_SQL, R, _asked, _observed, query
from .views import REVIEWS_SQL, RUNS_SQL, USAGE_SQL

CHOICES = lambda i, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
SQL_CHOICES = lambda i, *values: "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][{i} % {len(values)} + 1]"


# ---- scalars --------------------------------------------------------------------------------------------------


STARS = ("ONE", "FIVE", "SIX", None)


@query(f"""WITH c AS (SELECT s_suppkey AS id, {SQL_CHOICES('s_suppkey', *STARS)} AS stars, (s_suppkey % 11) / 10.0 AS confidence, {SQL_CHOICES('s_suppkey', 'positive', 'negative', None)} AS label, {SQL_CHOICES('s_suppkey', 'rating', 'model')} AS source FROM supplier)
SELECT id, CASE stars WHEN 'ONE' THEN 1 WHEN 'FIVE' THEN 5 END AS rating, CASE WHEN confidence < 0.6 THEN 'neutral' ELSE label END AS sentiment, CASE WHEN label IS NOT NULL THEN label || CASE source WHEN 'rating' THEN ' · from rating' ELSE ' · model' END ELSE '' END AS judgment FROM c""")
def sentiment_labels(spark, d):
    """Named stars, sentiment under a confidence threshold, and the label that says where it comes from."""
    i = F.col("s_suppkey")
    c = views.table(spark, d, "supplier").select(i.alias("id"), CHOICES(i, *STARS).alias("stars"), ((i % 11) / 10.0).alias("confidence"), CHOICES(i, "positive", "negative", None).alias("label"), CHOICES(i, "rating", "model").alias("source"))
    return c.select("id", S.rating_from_stars(F.col("stars")).alias("rating"), S.sentiment_result(F.col("label"), F.col("confidence")).alias("sentiment"), S.sentiment_judgment(F.col("label"), F.col("source")).alias("judgment"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 50 ELSE 1 END AS projects, CASE WHEN c_custkey % 3 = 0 THEN 100000 ELSE 5000 END AS reviews, CASE WHEN c_custkey % 3 = 0 THEN 2000000 ELSE 50000 END AS queries FROM customer""")
def plan_limits(spark, d):
    """Limits by plan; an unknown one is the free plan."""
    i, plan = F.col("c_custkey"), CHOICES(F.col("c_custkey"), "paid", "free", "gold")
    return views.table(spark, d, "customer").select(i.alias("id"), *[S.plan_limit(plan, what).alias(name) for name, what in (("projects", "projects"), ("reviews", "reviews_per_project"), ("queries", "queries_per_month"))])


TYPES = ("gcid:Dental_Clinic", "categories/plumber", "thai_restaurant", "zoo", None)


@query(f"""WITH t AS (SELECT p_partkey AS id, {SQL_CHOICES('p_partkey', *TYPES)} AS kind FROM part) SELECT id, CASE kind WHEN 'gcid:Dental_Clinic' THEN 'dental' WHEN 'categories/plumber' THEN 'plumbing' WHEN 'thai_restaurant' THEN 'restaurant' END AS category FROM t""")
def categories(spark, d):
    i = F.col("p_partkey")
    return views.table(spark, d, "part").select(i.alias("id"), S.category_from_type(CHOICES(i, *TYPES)).alias("category"))


URLS = ("HTTPS://Shop.example:443/", "http://a.b:8080", "ftp://a", "https://x.example/path", "nothing")
ORIGINS = ("https://shop.example", "http://a.b:8080", None, None, None)


@query(f"""SELECT page_id AS id, {SQL_CHOICES('page_id', *ORIGINS)} AS origin, page_id % 5 IN (0, 1, 3) AS web, regexp_matches(url, '^https?://[^\\s/?#]+', 'i') AS page_is_web FROM pages""")
def web_addresses(spark, d):
    """Origins in their usual form, and what is a web address."""
    i, u = F.col("page_id"), CHOICES(F.col("page_id"), *URLS)
    return views.table(spark, d, "pages").select(i.alias("id"), S.origin(u).alias("origin"), S.is_http_url(u).alias("web"), S.is_http_url(F.col("url")).alias("page_is_web"))


@query("""WITH k AS (SELECT o_orderkey AS id, md5(o_orderkey::VARCHAR) AS h, CASE WHEN o_orderkey % 2 = 0 THEN 'sk' ELSE 'pk' END AS t, CASE WHEN o_orderkey % 3 = 0 THEN 'test' WHEN o_orderkey % 3 = 1 THEN 'live' ELSE 'prod' END AS e FROM orders)
SELECT id, CASE WHEN e = 'prod' THEN NULL WHEN t = 'sk' THEN 'secret' ELSE 'publishable' END AS kind, CASE WHEN e = 'prod' THEN NULL ELSE e END AS environment FROM k""")
def api_keys(spark, d):
    """Kind and environment that a key claims."""
    i = F.col("o_orderkey")
    key = F.concat_ws("_", F.lit("ml"), CHOICES(i, "sk", "pk"), CHOICES(i, "test", "live", "prod"), F.md5(i.cast("string")))
    return views.table(spark, d, "orders").select(i.alias("id"), S.key_parts(key).alias("k")).select("id", "k.kind", "k.environment")


@query("""SELECT event_id AS id, len(list_filter(['sweep', CASE WHEN minute(t) = 0 AND hour(t) % 6 = 0 THEN 'google_poll' END, CASE WHEN hour(t) = 3 AND minute(t) = 30 THEN 'places_refresh' END, CASE WHEN hour(t) = 4 AND minute(t) = 15 THEN 'account_purge' END], lambda x: x IS NOT NULL)) AS jobs,
CASE WHEN event_id % 4000 * 1000 < 60000 THEN 2000 WHEN event_id % 4000 * 1000 < 300000 THEN 10000 WHEN event_id % 4000 * 1000 < 1800000 THEN 30000 END AS delay FROM (SELECT event_id, to_timestamp(epoch(date_trunc('second', ts))::BIGINT // 300 * 300) AT TIME ZONE 'UTC' AS t FROM events)""")
def schedules(spark, d):
    """Jobs due at a tick, and how long a page waits before it asks again."""
    e = views.table(spark, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return e.select(F.col("event_id").alias("id"), F.size(S.jobs_due(F.col("s"))).cast("bigint").alias("jobs"), S.poll_delay_ms(F.col("event_id") % 4000 * 1000).alias("delay"))


@query(f"""WITH {REVIEWS_SQL} SELECT id, coalesce(rating, 0) % 2 = 0 AS same, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS left_over FROM reviews_v""")
def metadata_maps(spark, d):
    """Maps compared whatever their order, and a key taken out."""
    i = F.col("id")
    m = lambda *kv: F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in kv]))
    a = m(("x", i.cast("string")), ("y", F.lit("1")))
    b = m(("y", F.lit("1")), ("x", F.when(F.coalesce("rating", F.lit(0)) % 2 == 0, i.cast("string")).otherwise("other")))
    drop = F.when(i % 2 == 0, F.size(S.without_key(a, "y"))).otherwise(F.size(S.without_key(a, "z")))
    return R(spark, d).select("id", S.same_map(a, b).alias("same"), drop.alias("left_over"))


@query(f"""WITH {REVIEWS_SQL} SELECT id, substr(source, 1, 2) AS before, substr(source, 3, 3) AS mark, substr(source, 6) AS after FROM reviews_v""")
def highlights(spark, d):
    h = S.highlight(F.col("source"), F.lit(2), F.lit(3))
    return R(spark, d).select("id", h.alias("h")).select("id", "h.before", "h.mark", "h.after")


# ---- imports, accounts, projects ------------------------------------------------------------------------------


@query("""WITH new AS (SELECT c_custkey AS org, max(o_orderkey) AS ordinal FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0 GROUP BY c_custkey)
SELECT c_custkey AS org, CASE WHEN ordinal IS NOT NULL THEN 'new ' || ordinal ELSE 'old ' || c_custkey END AS name, CASE WHEN ordinal IS NOT NULL THEN NULL WHEN c_custkey % 7 = 0 THEN c_custkey END AS deleted_s, CASE WHEN c_custkey % 2 = 0 THEN 'first' WHEN ordinal IS NOT NULL THEN 'by ' || ordinal END AS creator
FROM customer LEFT JOIN new ON org = c_custkey WHERE c_custkey % 5 <> 0 OR ordinal IS NOT NULL""")
def account_upsert(spark, d):
    """Accounts by organisation: the name follows, a deletion is undone, the first creator stays."""
    c, o = views.table(spark, d, "customer"), views.table(spark, d, "orders").filter("o_orderkey % 3 = 0")
    k = F.col("c_custkey")
    old = c.filter(k % 5 != 0).select(k.alias("org"), F.concat(F.lit("old "), k).alias("name"), F.when(k % 7 == 0, k).alias("deleted_s"), F.when(k % 2 == 0, "first").alias("creator"))
    made = o.join(c, F.col("o_custkey") == k).select(k.alias("org"), F.concat(F.lit("new "), F.col("o_orderkey")).alias("name"), F.when(k % 2 == 0, "first").otherwise(F.concat(F.lit("by "), F.col("o_orderkey"))).alias("creator"), F.col("o_orderkey").alias("ordinal"))
    return imports.account_upsert(old, made).select("org", "name", "deleted_s", "creator")


PLACES = "CASE WHEN id % 5 = 0 AND id % 2 = 0 THEN 'places/' || id % 6 || '/' || id ELSE external_id END"


def _bootstrapped(spark, d):
    return R(spark, d).withColumn("external_id", F.when((F.col("id") % 5 == 0) & (F.col("id") % 2 == 0), F.concat(F.lit("places/"), F.col("id") % 6, F.lit("/"), F.col("id"))).otherwise(F.col("external_id")))


@query(f"""WITH {REVIEWS_SQL}, b AS (SELECT id, project_id, environment, source, {PLACES} AS external_id FROM reviews_v), gone AS (SELECT project_id, environment, count(*) AS n FROM b WHERE source = 'google' AND external_id LIKE 'places/%' GROUP BY ALL)
SELECT (SELECT count(*) FROM b) - (SELECT sum(n) FROM gone)::BIGINT AS kept, (SELECT sum(n)::BIGINT FROM gone WHERE environment = 'live') AS live_gone""")
def bootstrap_superseded(spark, d):
    """What an import of the full history makes superfluous, and how many went from each project."""
    kept, gone = imports.supersede_bootstrap(_bootstrapped(spark, d))
    return kept.agg(F.count(F.lit(1)).alias("kept")).join(gone.filter("environment = 'live'").agg(F.sum("removed").alias("live_gone")), F.lit(True))


@query(f"""WITH {REVIEWS_SQL}, b AS (SELECT id, {PLACES} AS external_id FROM reviews_v) SELECT id FROM b WHERE external_id LIKE 'places/2/%' AND id % 4 <> 0""")
def bootstrap_stale(spark, d):
    """Reviews of a place that it no longer returns."""
    b = _bootstrapped(spark, d)
    return imports.stale_bootstrap(b, b.filter("id % 4 = 0").select("external_id"), "places/2/").select("id")


@query("""SELECT o_orderkey AS id, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + (o_custkey % 4) <= CASE WHEN o_custkey % 3 = 0 THEN 50 ELSE 1 END THEN 'created' ELSE 'over quota' END AS verdict FROM orders""")
def project_quota(spark, d):
    """New projects against their account's plan, in the order in which they come."""
    o, c = views.table(spark, d, "orders"), views.table(spark, d, "customer")
    wanted = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("ordinal"))
    have = c.select(F.col("c_custkey").alias("account_id"), CHOICES(F.col("c_custkey"), "paid", "free", "free").alias("plan"), (F.col("c_custkey") % 4).alias("projects"))
    return imports.create_projects(wanted, have).select("id", "verdict")


@query("""SELECT o_orderkey AS id, o_orderkey % 4 = 0 OR o_orderkey % 5 = 0 AS policy_changed, CASE WHEN o_orderkey % 6 = 0 THEN 'n' || o_orderkey ELSE 'p' || o_orderkey END AS name FROM orders""")
def project_updates(spark, d):
    """Changed fields of projects, and whether the publication policy is among them."""
    i = F.col("o_orderkey")
    old = views.table(spark, d, "orders").select(i.alias("id"), F.concat(F.lit("p"), i).alias("name"), F.lit(4).alias("min_rating"), F.lit(0.66).alias("similarity_floor"))
    new = views.table(spark, d, "orders").select(i.alias("id"), F.when(i % 6 == 0, F.concat(F.lit("n"), i)).alias("name"), F.when(i % 4 == 0, 3).alias("min_rating"), F.when(i % 5 == 0, 0.7).when(i % 7 == 0, 0.66).alias("similarity_floor"))
    return imports.update_projects(old, new).select("id", "policy_changed", "name")


@query(f"""WITH {REVIEWS_SQL} SELECT id, dense_rank() OVER (PARTITION BY place_name ORDER BY occurred_s NULLS FIRST, external_id) AS place FROM reviews_v""")
def order_in_location(spark, d):
    """Reviews of a location by when they were written, then by name."""
    return imports.in_location_order(R(spark, d), "place_name", "occurred_s", "external_id").select("id", F.col("place").cast("bigint").alias("place"))


@query(f"""WITH {REVIEWS_SQL} SELECT source, count(*) AS total, count(*) FILTER (WHERE indexed_s IS NOT NULL) AS indexed, count(*) FILTER (WHERE indexed_s IS NULL) AS pending FROM reviews_v WHERE NOT hidden GROUP BY source""")
def reindex_counts(spark, d):
    return imports.reindex_counts(R(spark, d).filter(~F.col("hidden")), "source")


@query("""SELECT doc_id AS id FROM documents WHERE doc_id % 4 = 0 OR doc_id * 30 <= doc_id * 60 - 3000""")
def fresher_reviews(spark, d):
    """Export rows that are new, or edited after what is stored."""
    r = R(spark, d)
    export = r.select("id", F.col("external_id").alias("suffix"), (F.col("id") * 60 - 3000).alias("edited_ms"))
    stored = r.filter("id % 4 <> 0").select(F.col("external_id").alias("suffix"), (F.col("id") * 30).alias("as_of_ms"))
    return access.fresher_than_stored(export, stored).select("id")


@query(f"""WITH {RUNS_SQL} SELECT project_id AS run_id, sum(received)::BIGINT AS received, sum(created)::BIGINT AS created, (sum(created) + sum(received % 3) + sum(received % 2) + sum(received % 5))::BIGINT AS processed, arg_max(status, id) AS status FROM runs_v GROUP BY project_id""")
def run_totals(spark, d):
    """Records of an import run summed field by field; the last one closes it."""
    r, n = views.runs(spark, d), F.col("received")
    records = r.select(F.col("project_id").alias("run_id"), "received", "created", (n % 3).alias("updated"), (n % 2).alias("skipped"), (n % 5).alias("failed"), "status", F.col("id").alias("at"))
    return api.run_totals(records).select("run_id", "received", "created", "processed", "status")


@query("""SELECT doc_id AS row FROM documents WHERE doc_id > 120""")
def resumed_import(spark, d):
    """What is left of an import that broke off."""
    return access.resume(views.table(spark, d, "documents").select(F.col("doc_id").alias("row")), 120)


REJECT_SQL = """inserts AS (SELECT o_custkey AS project_id, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)"""


@query(f"""WITH {REJECT_SQL} SELECT o_orderkey AS ordinal, coalesce(n > 5, false) AS over FROM orders LEFT JOIN inserts ON project_id = o_custkey""")
def cap_rejects(spark, d):
    """The reject policy: a batch with more inserts than there is room is refused whole."""
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderkey") % 3 == 0, "insert").otherwise("update").alias("action"), F.col("o_orderkey").alias("ordinal"))
    room = views.table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.lit(5).alias("room"))
    return dml.capped(o, room, "reject").select("ordinal", "over")


@query("""SELECT c_custkey AS account_id, CASE WHEN c_custkey = 7 THEN 'paid' ELSE 'free' END AS plan, count(o_orderkey) AS projects, count(*) FILTER (WHERE o_orderkey IS NOT NULL AND c_custkey <> 7) AS badges FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def plan_change(spark, d):
    """An account's plan and the badge of its projects with it."""
    accounts = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("free").alias("plan"))
    projects = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), F.lit(True).alias("show_badge"))
    a, p = dml.change_plan(accounts, projects, 7, "paid", False)
    n = p.groupBy("account_id").agg(F.count(F.lit(1)).alias("projects"), F.count_if("show_badge").alias("badges"))
    return a.select(F.col("id").alias("account_id"), "plan").join(n, "account_id", "left").na.fill(0, ["projects", "badges"])


@query("""SELECT p_partkey AS id, p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AS enabled, CASE WHEN p_partkey % 4 = 0 THEN 'p' || p_partkey END AS title FROM part""")
def locations_selected(spark, d):
    """Locations found, those enabled that are verified and wanted, and their listing names."""
    i = F.col("p_partkey")
    found = views.table(spark, d, "part").select(i.alias("id"), (i % 3 != 0).alias("verified"))
    wanted = views.table(spark, d, "part").filter(i % 2 == 0).select(i.alias("id"))
    titles = views.table(spark, d, "part").filter(i % 4 == 0).select(i.alias("id"), F.concat(F.lit("p"), i).alias("title"))
    return imports.select_locations(found, wanted, titles)


# ---- evaluation, usage ----------------------------------------------------------------------------------------


@query(f"""WITH {OBSERVED_SQL}, cuts AS (SELECT round(0.3 + i * 0.1, 1) AS cut FROM range(6) t(i)), tried AS (SELECT r.*, cut, CASE WHEN rank % 3 <> 0 THEN (rank * 37 % 100) / 100.0 END >= cut AS pass FROM rows r, cuts), {POINT_SQL.format(keys="cut")}
SELECT cut::DOUBLE AS cut, tp AS true_positives, fp AS false_positives, answered, negative_hits FROM point""")
def reranker_curve(spark, d):
    """Cuts of a reranker's score; rows it has not scored never pass."""
    scored = _observed(spark, d).withColumn("rerank", F.when(F.col("rank") % 3 != 0, (F.col("rank") * 37 % 100) / 100.0))
    c = evals.reranker_curve(scored, _asked(spark), evals.floor_steps(0.3, 0.8, 0.1))
    return c.select("cut", "true_positives", "false_positives", "answered", "negative_hits")


@query("""SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'run2' ELSE 'run1' END AS run_id, CASE WHEN vec_id % 2 = 0 THEN vec_id * 2 ELSE vec_id END AS score, CASE WHEN vec_id % 2 = 0 THEN 77 END::BIGINT AS saved_s FROM embeddings WHERE vec_id % 2 = 1 OR vec_id % 4 = 0""")
def evaluation_written_back(spark, d):
    """A run's rows in place of what it had; other runs stay."""
    v = F.col("vec_id")
    runs = views.table(spark, d, "embeddings").select("vec_id", F.when(v % 2 == 0, "run2").otherwise("run1").alias("run_id"), v.alias("score"), F.lit(None).cast("bigint").alias("saved_s"))
    own = views.table(spark, d, "embeddings").filter(v % 4 == 0).select("vec_id", (v * 2).alias("score"))
    return evals.write_back(runs, own, "run2", 77)


@query("""SELECT vec_id AS review_id, CASE WHEN vec_id % 3 = 0 THEN 'k' || vec_id ELSE '?' || vec_id END AS key, vec_id % 2 = 0 AS lexical FROM embeddings""")
def labelled_results(spark, d):
    """Results with the keys of the labelled set, and a mark for each excerpt."""
    v = F.col("vec_id")
    e = views.table(spark, d, "embeddings")
    keyed = access.with_fixture_keys(e.select(v.alias("review_id"), v.alias("chunk_id")), e.filter(v % 3 == 0).select(v.alias("review_id"), F.concat(F.lit("k"), v).alias("key")))
    return api.annotate(keyed, e.select(v.alias("chunk_id"), (v % 2 == 0).alias("lexical"))).select("review_id", "key", "lexical")


@query(f"""WITH {USAGE_SQL}, b AS (SELECT event_id, project_id, epoch(date_trunc('second', ts))::BIGINT // 5 + 1 AS slot, cache_hit, event_id % 3 <> 0 AS ok FROM usage_v),
f AS (SELECT DISTINCT project_id, slot FROM b WHERE ok), t AS (SELECT b.event_id, b.project_id, b.cache_hit, f.slot AS flush FROM b ASOF LEFT JOIN f ON f.project_id = b.project_id AND f.slot >= b.slot)
SELECT project_id, flush, count(*) AS queries, sum(cache_hit)::BIGINT AS cache_hits FROM t GROUP BY ALL""")
def buffered_usage(spark, d):
    """Usage counts that wait for the next flush that succeeds."""
    events = views.usage(spark, d).withColumn("flushed", F.col("event_id") % 3 != 0)
    return jobs.buffered_flush(events).groupBy("project_id", "flush").agg(F.sum("queries").alias("queries"), F.sum("cache_hits").alias("cache_hits"))


@query("""WITH m AS (SELECT user_id AS project_id, CASE WHEN event_type = 'purchase' THEN 'clear' ELSE 'mark' END AS kind, event_id AS at_s FROM events), l AS (SELECT project_id, arg_max(kind, at_s) AS kind, max(at_s) AS at_s FROM m GROUP BY project_id)
SELECT project_id, kind = 'mark' AND at_s + 3600 > (SELECT max(event_id) + 1000 FROM events) AS pending FROM l""")
def sweep_markers(spark, d):
    e = views.table(spark, d, "events")
    marks = e.select(F.col("user_id").alias("project_id"), F.when(F.col("event_type") == "purchase", "clear").otherwise("mark").alias("kind"), F.col("event_id").alias("at_s"))
    return jobs.marker_state(marks, e.agg(F.max("event_id")).first()[0] + 1000)


@query("""SELECT environment, count(*) AS n, count(*) FILTER (WHERE i % 8 = 7) AS unrated, count(*) FILTER (WHERE i % 4 = 0) AS yelp, min(1700000000 - i * 86400) AS oldest_s, count(*) AS embedded FROM (SELECT i, CASE WHEN i < 80 THEN 'live' ELSE 'test' END AS environment FROM range(90) t(i)) GROUP BY environment""")
def demo_seed(spark, d):
    """The demonstration project: reviews with their excerpts and vectors."""
    rows, parts = generate.demo(spark, 1_700_000_000)
    told = rows.join(parts.filter("size(embedding) = 64").select(F.col("review_id").alias("id")), "id", "left_semi")
    return told.groupBy("environment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rating").isNull()).alias("unrated"), F.count_if(F.col("source") == "yelp").alias("yelp"), F.min("occurred_s").alias("oldest_s"), F.count(F.lit(1)).alias("embedded"))


@query(f"""WITH {REVIEWS_SQL} SELECT id FROM reviews_v WHERE place_name = 'place3' ORDER BY id % 5 DESC, id % 7 DESC, external_id LIMIT 40""")
def connector_page(spark, d):
    """A location's reviews as a connector returns them: newest update first."""
    r = R(spark, d).filter("place_name = 'place3'").select("id", (F.col("id") % 5).alias("update_ms"), (F.col("id") % 7).alias("create_ms"), F.col("external_id").alias("name"))
    return imports.newest_update_first(r).limit(40).select("id")
