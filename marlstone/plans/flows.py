"""Queries over what happens in time: retries, the queue's quota, polling, resumed imports, pacing and penalties."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import imports, search
from ..operators.outbox import Outbox, sweep_and_send
from ..operators.pacing import paced, penalised
from ..operators.resumable import COUNTS, ResumableImport
from ..sources import polling, variants
from ..sources.snapshots import SnapshotTable
from ..storage import fresh_path
from ..streaming import delivery
from . import views
from .queries import EPOCH, R, _rounded, _vector_sql, query
from .views import REVIEWS_SQL

# ---- messages -------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT user_id::VARCHAR AS review_id, event_id::VARCHAR AS message_id, epoch(date_trunc('second', ts))::BIGINT AS s, event_id % 6 AS failures FROM events),
waits(attempt, waited) AS (VALUES (1, 0), (2, 30), (3, 90), (4, 210))
SELECT review_id, message_id, attempt, s + waited AS due_s, CASE WHEN attempt < least(failures + 1, 4) THEN 'retried' WHEN failures > 3 THEN 'dead' ELSE 'done' END AS outcome
FROM m JOIN waits ON attempt <= least(failures + 1, 4)""")
def message_deliveries(spark, d):
    """Every delivery of messages that fail up to five times: when it is due, and whether it ends well or in the dead letters."""
    i = F.col("event_id")
    messages = views.table(spark, d, "events").select(F.col("user_id").cast("string").alias("review_id"), i.cast("string").alias("message_id"), F.date_trunc("SECOND", F.col("ts").cast("timestamp")).alias("at"), (i % 6).alias("failures"))
    return delivery.replay(messages).select("review_id", "message_id", "attempt", F.unix_timestamp("due").alias("due_s"), F.col("end").alias("outcome"))


@query(f"""WITH {REVIEWS_SQL}, stuck AS (SELECT id, index_attempts, updated_s, row_number() OVER (ORDER BY updated_s, id) AS n FROM reviews_v WHERE indexed_s IS NULL AND NOT hidden AND index_attempts < 5 ORDER BY n LIMIT 1000),
b AS (SELECT *, (n - 1) // 100 AS batch, count(*) OVER () AS total FROM stuck)
SELECT id, n, batch, least((batch + 1) * 100, total) <= 30 AS sent, index_attempts + CASE WHEN least((batch + 1) * 100, total) <= 30 THEN 1 ELSE 0 END AS index_attempts FROM b""")
def sweep_under_quota(spark, d):
    """The sweep's messages in batches, sent while the quota has room, and the attempts of those put off given back."""
    stuck = R(spark, d).filter("indexed_s IS NULL AND NOT hidden")
    out = sweep_and_send(stuck.select("id", "index_attempts", "updated_s"), 30)
    return out.select("id", F.col("n").cast("bigint").alias("n"), F.col("batch").cast("bigint").alias("batch"), "sent", F.col("index_attempts").cast("bigint").alias("index_attempts"))


@query(f"""WITH {REVIEWS_SQL}, n AS (SELECT id % 3 AS epoch, count(*) AS n FROM reviews_v GROUP BY 1),
sizes AS (SELECT max(n) FILTER (epoch = 0) AS n0, max(n) FILTER (epoch = 1) AS n1, max(n) FILTER (epoch = 2) AS n2 FROM n),
a AS (SELECT *, CASE WHEN n0 <= 450 THEN n0 ELSE 400 END AS s0 FROM sizes),
b AS (SELECT *, CASE WHEN n1 <= 450 - s0 THEN n1 ELSE (450 - s0) // 100 * 100 END AS s1 FROM a),
c AS (SELECT *, CASE WHEN n2 <= 450 - s0 - s1 THEN n2 ELSE (450 - s0 - s1) // 100 * 100 END AS s2 FROM b)
SELECT unnest([0, 1, 2]) AS epoch, unnest([s0, s1, s2]) AS sent, unnest([n0 - s0, n1 - s1, n2 - s2]) AS deferred FROM c""")
def outbox_totals(spark, d):
    """Three micro-batches under one quota, one of them sent twice: nothing goes out twice."""
    box = Outbox(SnapshotTable(spark, fresh_path(spark, "outbox")), 450)
    messages = R(spark, d).select("id", "index_attempts", "updated_s")
    for epoch in (0, 1, 1, 2):
        box.send(messages.filter(F.col("id") % 3 == epoch), epoch)
    return box.table.read().groupBy(F.col("epoch").cast("bigint").alias("epoch")).agg(F.count_if("sent").alias("sent"), F.count_if(~F.col("sent")).alias("deferred"))


# ---- polling --------------------------------------------------------------------------------------------------


@query(f"""WITH {REVIEWS_SQL}, r AS (SELECT 'l' || id % 11 AS location, external_id AS name, (updated_s - id % 4 * 30) * 1000 AS update_ms, {EPOCH}000 + id % 5 AS create_ms, text AS comment FROM reviews_v)
SELECT location, (row_number() OVER (PARTITION BY location ORDER BY update_ms DESC, create_ms DESC, name) - 1) // 20 AS page, name, update_ms, create_ms, comment FROM r""")
def connector_pages(spark, d):
    """All reviews as a connector serves them: pages of each location, newest update first, then newest created, then by name."""
    i, path = F.col("id"), fresh_path(spark, "connector")
    rows = R(spark, d).select(F.concat(F.lit("l"), i % 11).alias("location"), F.col("external_id").alias("name"), ((F.col("updated_s") - i % 4 * 30) * 1000).alias("update_ms"), (F.lit(EPOCH * 1000) + i % 5).alias("create_ms"), F.lit("FIVE").alias("stars"), F.col("text").alias("comment"))
    polling.store_reviews(rows, path)
    return polling.pages(spark, path, 20).select("location", F.col("page").cast("bigint").alias("page"), "name", "update_ms", "create_ms", "comment")


# ---- imports that pause ---------------------------------------------------------------------------------------

IMPORT_SQL = """WITH size AS (SELECT greatest(1, count(*) // 7) AS n FROM orders),
r AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS row, o_custkey % 97 AS key, o_orderpriority AS priority, o_orderstatus AS status, o_orderkey % 10 <> 3 AS good FROM orders),
b AS (SELECT *, (row - 1) // (SELECT n FROM size) AS batch FROM r),
l AS (SELECT *, good AND row = max(row) OVER (PARTITION BY batch, key, good) AS last FROM b),
k AS (SELECT *, lag(priority || status) OVER (PARTITION BY key ORDER BY batch) AS before FROM l WHERE last),
o AS (SELECT CASE WHEN before IS NULL THEN 'created' WHEN before = priority || status THEN 'skipped' ELSE 'updated' END AS outcome FROM k
  UNION ALL SELECT CASE WHEN good THEN 'skipped' ELSE 'failed' END FROM l WHERE NOT last)"""


def _uploaded(spark, d):
    from ..operators.search import counted_rank

    o = views.table(spark, d, "orders").select(F.lit(0).alias("query_id"), F.col("o_orderkey").alias("i"), (F.col("o_custkey") % 97).alias("key"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return counted_rank(o, "row", "i").drop("query_id")


def _resumed(spark, d):
    """An import that pauses after two batches, and again, and then runs to its end."""
    rows, path = _uploaded(spark, d), fresh_path(spark, "import")
    size = max(1, rows.count() // 7)
    for budget in (2, 3, None):
        run = ResumableImport(SnapshotTable(spark, path), "key", ["priority", "status"], F.col("i") % 10 != 3)
        told = run.run(rows, size, budget)
    return run, told


@query(IMPORT_SQL + "\nSELECT count(*) AS received, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed, 'succeeded' AS status FROM o")
def import_ledger(spark, d):
    """Totals of an import that was paused and resumed twice, as its ledger has them."""
    _, told = _resumed(spark, d)
    return spark.createDataFrame([(*(told[c] for c in COUNTS), told["status"])], ", ".join(f"{c} bigint" for c in COUNTS) + ", status string")


@query(IMPORT_SQL + "\nSELECT key, priority, status FROM l WHERE last QUALIFY row_number() OVER (PARTITION BY key ORDER BY row DESC) = 1")
def imported_rows(spark, d):
    """What that import has stored."""
    return _resumed(spark, d)[0].current()


# ---- limits in time -------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT user_id % 50 AS k, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id % 50 ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
s AS (SELECT k, event_id, n, t AS start_ms, [t] AS slots FROM e WHERE n = 1
  UNION ALL SELECT e.k, e.event_id, e.n, x.start, list_append(s.slots[-4:], x.start) FROM s JOIN e ON e.k = s.k AND e.n = s.n + 1,
    LATERAL (SELECT greatest(e.t, s.slots[-1] + 400000, CASE WHEN len(s.slots) >= 5 THEN s.slots[-5] + 3600000 ELSE 0 END) AS start) x)
SELECT k, event_id, n, start_ms FROM s""")
def paced_requests(spark, d):
    """When each request may go: so long after the one before, and so many in a period."""
    e = views.table(spark, d, "events").select((F.col("user_id") % 50).alias("k"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return paced(e, "k", 400_000, 5, 3_600_000).select("k", "event_id", F.col("n").cast("bigint").alias("n"), "start_ms")


@query("""WITH e AS (SELECT user_id % 50 AS k, event_id, ts, (event_type IN ('error', 'view'))::BIGINT AS bad, floor(epoch(ts) / 86400) AS p FROM events)
SELECT k, event_id, sum(bad) OVER (PARTITION BY k, p ORDER BY ts, event_id) - bad >= 3 AS blocked FROM e""")
def penalty_box(spark, d):
    """Who is shut out until a period ends, after three failures in it."""
    e = views.table(spark, d, "events").select((F.col("user_id") % 50).alias("k"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").isin("error", "view").alias("failed"))
    return penalised(e, "k", 3, 86_400)


# ---- half precision -------------------------------------------------------------------------------------------

#: binary16 by the same steps in SQL: the power of two at or below, the step within it, the nearest even count of steps.
HALF_SQL = """CASE WHEN abs(x) >= 65520 THEN sign(x) * 'inf'::DOUBLE WHEN x = 0 THEN 0.0 ELSE
  round_even(x / power(2.0, greatest(floor(log2(abs(x))), -14) - 10), 0) * power(2.0, greatest(floor(log2(abs(x))), -14) - 10) END"""
HALVED = f"list_transform(embedding::DOUBLE[], lambda x: {HALF_SQL})"


@query(f"SELECT vec_id, round(list_sum({HALVED}), 9) AS total, list_count(list_filter(list_zip(embedding::DOUBLE[], {HALVED}), lambda p: p[1] <> p[2])) AS changed, array_to_string(list_transform({HALVED}, lambda x: (x * 16777216)::BIGINT), ',') AS numbers FROM embeddings")
def half_precision(spark, d):
    """Vectors rounded to half precision and stored as shorts: their numbers (in steps of 2^-24), and how many changed."""
    v = views.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).withColumn("half", V.to_half(F.col("x"))).withColumn("y", V.from_half(F.col("half")))
    changed = F.size(F.filter(F.zip_with("x", "y", lambda a, b: a != b), lambda p: p)).cast("bigint")
    total = F.aggregate("y", F.lit(0.0), lambda s, x: s + x)
    return v.select("vec_id", F.round(total, 9).alias("total"), changed.alias("changed"), F.array_join(F.transform("y", lambda x: (x * 16777216).cast("bigint").cast("string")), ",").alias("numbers"))


@query(_vector_sql("WHERE similarity >= 0.1").replace("embedding::DOUBLE[] AS v", f"{HALVED} AS v").replace("THEN embedding::DOUBLE[] END", f"THEN {HALVED} END"))
def search_half_batch(spark, d):
    """The batch of vector searches over vectors in half precision: similarities and ranks are those of the rounded numbers."""
    halve = lambda c: V.from_half(V.to_half(c))
    chunks = views.chunks(spark, d).withColumn("half", V.to_half(F.col("embedding"))).withColumn("embedding", V.from_half(F.col("half"))).drop("half")
    rows = views.table(spark, d, "embeddings").filter("vec_id % 100 = 0").select("vec_id", halve(F.col("embedding").cast("array<double>")).alias("v")).collect()
    asked = [search.Query(r.vec_id, r.vec_id % 3, "live", 5 + r.vec_id // 100 % 4, 2, 0.1, vector=list(r.v)) for r in sorted(rows)]
    out = search.in_blocks(search.vector_search, R(spark, d), chunks, asked)
    return _rounded(out).select("query_id", "chunk_id", "review_id", "start_offset", "similarity", "rrf", F.lit(False).alias("below_floor"), "rating", "source")


# ---- nested JSON ----------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id AS row, props->>'k' AS k, user_id, event_type, value FROM events)
SELECT row, unnest(['type', 'by.user', 'by.tags', 'by.more.k', 'by.more.none', 'ok']) AS name,
  unnest([event_type, user_id::VARCHAR, '["a",' || k || ']', k, '', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END]) AS value, unnest([1, 2, 3, 4, 5, 6]) AS number FROM e""")
def flattened_json(spark, d):
    """Nested records as cells with dotted names, numbered in the order in which names first appear."""
    e = views.table(spark, d, "events")
    text = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "by": {"user": '), F.col("user_id").cast("string"), F.lit(', "tags": ["a", '), F.get_json_object("props", "$.k"), F.lit('], "more": {"k": '), F.get_json_object("props", "$.k"), F.lit(', "none": null}}, "empty": {}, "ok": '), F.when(F.col("user_id") % 2 == 0, "true").otherwise("false"), F.lit("}"))
    table = variants.cells(e.select(F.col("event_id").alias("row"), text.alias("json")))
    order = variants.headers(table).select("name", F.row_number().over(Window.orderBy("first")).cast("bigint").alias("number"))  # a row for each name
    return table.join(order, "name").select("row", "name", "value", "number")


# ---- projects -------------------------------------------------------------------------------------------------


def _projects(spark, d):
    return views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("account_id"), F.array(F.lit("https://old.example")).alias("allowed_origins"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 6 <> 0 THEN 'https://a' || c_custkey || '.example,http://b.example:8080' ELSE 'https://old.example' END AS origins, c_custkey % 3 = 0 AND c_custkey % 6 <> 0 AND false AS refused FROM customer""")
def project_origins(spark, d):
    """Origins set for every third project, of which every second names another account and is left alone."""
    i = F.col("id")
    given = F.array(F.concat(F.lit(" HTTPS://A"), i.cast("string"), F.lit(".example:443/")), F.lit("no address"), F.lit("http://b.example:8080"), F.concat(F.lit("https://a"), i.cast("string"), F.lit(".example")))
    wanted = _projects(spark, d).filter(i % 3 == 0).select("id", F.when(i % 6 == 0, -1).otherwise(F.col("account_id")).alias("account_id"), given.alias("origins"))
    return imports.set_origins(_projects(spark, d), wanted).select("id", F.array_join("allowed_origins", ",").alias("origins"), "refused")


@query("""WITH gone AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 8 <> 0)
SELECT id, (SELECT count(*) FROM orders WHERE o_custkey = id) AS reviews, (SELECT count(*) FROM events WHERE user_id = id) AS usage, (SELECT count(*) FROM customer) - (SELECT count(*) FROM gone) AS projects_left, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT id FROM gone)) AS reviews_left FROM gone""")
def projects_deleted(spark, d):
    """Projects deleted with all that is theirs; those of another account stay."""
    i = F.col("id")
    wanted = _projects(spark, d).filter(i % 4 == 0).select("id", F.when(i % 8 == 0, -1).otherwise(F.col("account_id")).alias("account_id"))
    children = {"reviews": views.table(spark, d, "orders").select(F.col("o_custkey").alias("project_id")), "usage": views.table(spark, d, "events").select(F.col("user_id").alias("project_id"))}
    left, kept, counts = imports.delete_projects(_projects(spark, d), wanted, **children)
    totals = left.agg(F.count(F.lit(1)).alias("projects_left")).join(F.broadcast(kept["reviews"].agg(F.count(F.lit(1)).alias("reviews_left"))), F.lit(True))  # one row each
    return counts.join(F.broadcast(totals), F.lit(True))


@query("""SELECT c_custkey AS id, count(event_id) AS queries, coalesce(sum((event_type = 'view')::BIGINT), 0)::BIGINT AS cache_hits FROM customer LEFT JOIN events ON user_id = c_custkey AND date_trunc('month', ts) = DATE '2024-01-01' GROUP BY c_custkey""")
def usage_of_all_projects(spark, d):
    """Every project's usage of a month, those without any included."""
    u = views.table(spark, d, "events").select(F.col("user_id").alias("project_id"), F.trunc("ts", "MM").alias("month"), F.lit(1).alias("queries"), (F.col("event_type") == "view").cast("bigint").alias("cache_hits"))
    return imports.usage_of_projects(_projects(spark, d).select("id"), u, F.lit("2024-01-01").cast("date"))


@query("""SELECT o_custkey AS owner, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS place FROM orders QUALIFY place <= 3""")
def newest_of_each(spark, d):
    """The three newest runs of each project."""
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return imports.newest(o, "owner", "o_orderdate", "id", 3).select("owner", "id", F.col("place").cast("bigint").alias("place"))
