"""Queries over uploads and exports: files written from the given tables and read back, and vendors' shapes mapped to reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T
from ..sources import files, mapping
from ..sources.artifacts import ArtifactStore
from ..storage import fresh_path
from . import views
from .queries import EPOCH, query

# ---- CSV and JSON files ---------------------------------------------------------------------------------------

TEXTS = "SELECT doc_id::VARCHAR AS id, lang, source, md5(coalesce(text, '')) AS digest FROM documents"


#: Records of one uploaded JSON file, about; a CSV file has up to ten times as many.
RECORDS = 1000


def _csv(spark, d, delimiter):
    """All documents as CSV files with every field in quotes, doubled ones inside."""
    path = fresh_path(spark, "csv")
    docs = views.table(spark, d, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    # Files of a bounded size, as uploads are.
    docs.write.option("maxRecordsPerFile", 10 * RECORDS).csv(path, header=True, sep=delimiter, quoteAll=True, escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    return path


def _cells(rows):
    cell = lambda i: F.get("cells", F.lit(i))
    return rows.select(cell(0).alias("id"), cell(1).alias("lang"), cell(2).alias("source"), F.md5(F.coalesce(cell(3), F.lit(""))).alias("digest"))


@query(TEXTS)
def csv_files_by_record(spark, d):
    """Files parsed record by record, the delimiter told from the header; every cell of every row comes back."""
    return _cells(files.csv_cells(spark, _csv(spark, d, ";")))


@query(TEXTS)
def csv_files_by_line(spark, d):
    """The same read line by line in parallel: quotes say which lines belong together."""
    return _cells(files.csv_rows(spark, _csv(spark, d, "\t")))


@query("SELECT doc_id::VARCHAR AS id, lang AS \"in.lang\", CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END AS even, '[' || doc_id % 5 || ',\"x\"]' AS tags, '' AS nothing, md5(coalesce(text, '')) AS digest FROM documents".replace('"in.lang"', "in_lang"))
def json_files(spark, d):
    """JSON files, each an object with one array of records: nested names with dots, arrays as JSON, null as nothing."""
    i, path = F.col("doc_id"), fresh_path(spark, "json")
    record = F.struct(i.alias("id"), F.struct(F.col("lang")).alias("in"), (i % 2 == 0).alias("even"), F.coalesce("text", F.lit("")).alias("text"))
    tags = F.concat(F.lit(',"tags":['), (i % 5).cast("string"), F.lit(',"x"],"nothing":null}'))
    docs = views.table(spark, d, "documents")
    # An upload has a bounded size, so more documents are more files.
    n = max(1, -(-docs.count() // RECORDS))
    rows = docs.select(F.pmod(F.xxhash64(i), F.lit(n)).alias("file"), F.concat(F.regexp_replace(F.to_json(record), "\\}$", ""), tags).alias("json"))
    whole = rows.groupBy("file").agg(F.concat(F.lit('{"results": ['), F.array_join(F.collect_list("json"), ","), F.lit("]}")).alias("value"))
    whole.write.partitionBy("file").text(path)
    cells = files.json_cells(spark, path).select(F.map_from_arrays("headers", "cells").alias("c"))
    return cells.select(F.col("c")["id"].alias("id"), F.col("c")["in.lang"].alias("in_lang"), F.col("c")["even"].alias("even"), F.col("c")["tags"].alias("tags"), F.col("c")["nothing"].alias("nothing"), F.md5(F.col("c")["text"]).alias("digest"))


# ---- columns of uploads ---------------------------------------------------------------------------------------


def _upload(spark, d):
    i = F.col("doc_id")
    cells = F.array(F.concat(F.lit("r"), i.cast("string")), F.date_format(F.timestamp_seconds(F.lit(EPOCH) + i * 3600), "yyyy-MM-dd"), (1 + i % 5).cast("string"), F.coalesce("text", F.lit("")), F.concat(F.lit("https://x.example/"), i.cast("string")), F.lit(""))
    return ["Ref", "When", "Score", "What they said", "Link", "Empty"], views.table(spark, d, "documents").select(i.alias("row"), cells.alias("cells"))


@query("""WITH c AS (SELECT unnest(range(6)) AS column_number, unnest(['r' || doc_id, '2024-01-01', (1 + doc_id % 5)::VARCHAR, coalesce(text, ''), 'https://x.example/' || doc_id, '']) AS v FROM documents),
f AS (SELECT *, regexp_full_match(v, '\\s*') AS blank FROM c)
SELECT column_number, count(*) FILTER (NOT blank) AS filled, round(avg(CASE WHEN NOT blank THEN length(v) END), 6) AS length, CASE WHEN count(*) FILTER (NOT blank) > 0 THEN (column_number = 1)::INT::DOUBLE END AS dates, CASE WHEN count(*) FILTER (NOT blank) > 0 THEN (column_number = 4)::INT::DOUBLE END AS links FROM f GROUP BY column_number""")
def column_profile(spark, d):
    """Of each column of an upload: filled cells, their mean length, and the shares that read as dates and as links."""
    headers, cells = _upload(spark, d)
    rows = [(i, p["n"], p["len"], p["date"], p["link"]) for i, p in enumerate(mapping.profile_columns(cells, len(headers)))]
    told = spark.createDataFrame(rows, "column_number bigint, filled bigint, length double, dates double, links double")
    return told.withColumn("length", F.round("length", 6))


@query("SELECT unnest(['occurred_at', 'rating', 'text', 'url']) AS field, unnest(['When', 'Score', 'What they said', 'Link']) AS header")
def detected_columns(spark, d):
    """Which column of an upload is what, by headers and by what the cells of all rows read as."""
    headers, cells = _upload(spark, d)
    found = mapping.detect(headers, cells).fields
    return spark.createDataFrame(sorted(found.items()), "field string, header string")


# ---- exports --------------------------------------------------------------------------------------------------

#: Of every document one review, and of every seventh a second state on another page, edited later.
EXPORT_SQL = f"""WITH r AS (
  SELECT doc_id AS id, 'accounts/1/locations/' || doc_id % 11 || '/reviews/' || doc_id AS name, doc_id % 11 AS location, CASE WHEN doc_id % 5 <> 4 THEN coalesce(text, '') ELSE '' END AS text,
         ({EPOCH} + doc_id * 60) * 1000 AS created_ms, CASE WHEN doc_id % 7 = 0 THEN ({EPOCH} + doc_id * 60 + 86400) * 1000 ELSE ({EPOCH} + doc_id * 60) * 1000 END AS edited_ms, 1 + (doc_id % 7 = 0)::INT AS seen FROM documents),
t AS (SELECT *, regexp_replace(CASE WHEN seen = 2 AND text <> '' THEN 'Edited: ' || text ELSE text END, '^\\s+|\\s+$', '', 'g') AS final FROM r)"""


def _entries(spark, d):
    """Pages of an export, one for each location and state, the listing data of each location, and an entry of no interest."""
    i = F.col("doc_id")
    stamp = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(i % 5 != 4, F.coalesce("text", F.lit(""))).otherwise("")
    made = F.lit(EPOCH) + i * 60
    docs = views.table(spark, d, "documents").select(i.alias("i"), (i % 11).alias("location"), text.alias("text"), made.alias("made"), F.explode(F.when(i % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("state"))
    name = F.concat(F.lit("accounts/1/locations/"), F.col("location").cast("string"), F.lit("/reviews/"), F.col("i").cast("string"))
    said = F.when((F.col("state") == 1) & (F.col("text") != ""), F.concat(F.lit("Edited: "), "text")).otherwise(F.col("text"))
    review = F.struct(name.alias("name"), F.struct(F.lit("Ann").alias("displayName")).alias("reviewer"), F.lit("FOUR").alias("starRating"), said.alias("comment"), stamp(F.col("made")).alias("createTime"), stamp(F.col("made") + F.col("state") * 86400).alias("updateTime"))
    base = F.concat(F.lit("Takeout/Google Business Profile/account-1/location-"), F.col("location").cast("string"))
    page = F.pmod(F.xxhash64("i"), F.lit(4)) + F.col("state") * 4  # an export has pages of a bounded size
    pages = docs.groupBy("location", page.alias("page")).agg(F.to_json(F.struct(F.collect_list(review).alias("reviews"))).alias("text"))
    pages = pages.select(F.concat(base, F.lit("/reviews-"), F.col("page").cast("string"), F.lit(".json")).alias("path"), "text")
    listing = docs.select("location").distinct().select(F.concat(base, F.lit("/additionalData.json")).alias("path"), F.concat(F.lit('{"attributes": [{"id": {"attributeType": "LISTING_NAME"}, "values": [{"datum": {"listingName": {"text": " Shop '), F.col("location").cast("string"), F.lit('"}}}]}]}')).alias("text"))
    other = spark.createDataFrame([("Takeout/Mail/all.json", "{}"), ("Takeout/Maps (your places)/Reviews.json", '{"type": "FeatureCollection", "features": ["x"]}')], "path string, text string")
    return pages.union(listing).union(other)


@query(EXPORT_SQL + """, n AS (SELECT count(DISTINCT (location, md5(id::VARCHAR))) FROM t)
SELECT 'location-data' AS kind, count(DISTINCT location) AS entries, 0 AS valid FROM t UNION ALL SELECT 'maps-reviews', 1, 0 UNION ALL SELECT 'other', 1, 0 UNION ALL SELECT 'reviews', NULL, sum(seen) FROM t""")
def export_entries(spark, d):
    """What the entries of an export hold by their shape, and how many valid reviews."""
    told = mapping.classify_entries(_entries(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("entries"), F.sum("valid").alias("valid"))
    return told.select("kind", F.when(F.col("kind") != "reviews", F.col("entries")).alias("entries"), F.col("valid").cast("bigint").alias("valid"))


@query(EXPORT_SQL + """
SELECT name, CASE WHEN final = '' THEN 'star_only' WHEN length(final) > 20000 THEN 'invalid' ELSE 'ok' END AS status, edited_ms, seen, CASE WHEN final <> '' AND length(final) <= 20000 THEN md5(final) END AS digest,
       CASE WHEN final <> '' AND length(final) <= 20000 THEN 'Shop ' || location END AS title FROM t""")
def export_reviews(spark, d):
    """Every review of an export once, in the state edited last, as ok, star_only or invalid, with its listing's name."""
    out = mapping.map_takeout(mapping.takeout_reviews(_entries(spark, d)))
    name = F.concat(F.lit("accounts/1/"), "suffix")
    return out.select(F.when(F.startswith("suffix", F.lit("accounts/")), F.col("suffix")).otherwise(name).alias("name"), "status", "edited_ms", F.col("seen").cast("bigint").alias("seen"), F.md5("review.text").alias("digest"), F.col("review.metadata")["location_title"].alias("title"))


@query(EXPORT_SQL + " SELECT max(edited_ms) AS as_of_ms, sum(seen - 1) AS duplicates FROM t")
def export_date(spark, d):
    """The time up to which an export goes, and how many states of reviews were superseded."""
    r = mapping.export_as_of(mapping.takeout_reviews(_entries(spark, d)))
    return r.select("as_of_ms", F.col("duplicates").cast("bigint").alias("duplicates"))


@query(f"""SELECT 'p/' || doc_id AS name, CASE WHEN regexp_full_match(coalesce(text, ''), '\\s*') THEN 'star_only' ELSE 'ok' END AS status, CASE WHEN NOT regexp_full_match(coalesce(text, ''), '\\s*') THEN md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) END AS digest,
CASE WHEN NOT regexp_full_match(coalesce(text, ''), '\\s*') THEN 1 + doc_id % 5 END AS rating, CASE WHEN NOT regexp_full_match(coalesce(text, ''), '\\s*') THEN 'Place ' || doc_id % 6 END AS place FROM documents""")
def place_reviews(spark, d):
    """Reviews of places in a vendor's shape as common ones."""
    i = F.col("doc_id")
    review = F.struct(F.concat(F.lit("p/"), i.cast("string")).alias("name"), (1 + i % 5).alias("rating"), F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("languageCode")).alias("text"), F.lit("2024-01-05T10:00:00Z").alias("publishTime"))
    places = views.table(spark, d, "documents").groupBy((i % 6).alias("k"), F.pmod(F.xxhash64(i), F.lit(16)).alias("page")).agg(F.collect_list(review).alias("reviews"))
    raw = places.select(F.to_json(F.struct(F.concat(F.lit("id"), F.col("k").cast("string")).alias("id"), F.struct(F.concat(F.lit("Place "), F.col("k").cast("string")).alias("text")).alias("displayName"), "reviews")).alias("json"))
    out = mapping.map_places(raw)
    return out.select("name", "status", F.md5("review.text").alias("digest"), F.col("review.rating").cast("bigint").alias("rating"), F.col("review.metadata")["place_name"].alias("place"))


# ---- excerpts -------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS id, 1 AS wholes, true AS verbatim, true AS inside FROM documents WHERE regexp_matches(text, '\\S')")
def excerpts_are_slices(spark, d):
    """Every excerpt of every document against its text: one of the whole, all verbatim at their offsets (UTF-16 units)."""
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").filter(F.rlike("text", F.lit(r"\S")))
    # A text beside its excerpts, as UTF-16 units of two bytes: each excerpt is one slice of them, whatever characters the text has.
    units = lambda c: F.encode(c, "UTF-16BE")
    agrees = lambda whole, e: S.let(units(e["text"]), lambda own: F.substring(whole, e["start_offset"] * 2 + 1, F.octet_length(own)) == own)
    verbatim = S.let(units(F.col("text")), lambda whole: F.forall("excerpts", lambda e: agrees(whole, e)))
    inside = F.forall("excerpts", lambda e: (e["start_offset"] >= 0) & (F.length(e["text"]) > 0))
    each = T.excerpted(docs, with_text=True).groupBy(F.col("review_id").alias("id"))
    wholes = F.size(F.filter("excerpts", lambda e: e["kind"] == "full"))
    return each.agg(F.sum(wholes).alias("wholes"), F.every(verbatim).alias("verbatim"), F.every(inside).alias("inside"))


@query("""WITH t AS (SELECT doc_id AS id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS own FROM documents)
SELECT id, CASE WHEN own = '' AND id % 3 = 0 THEN '(Translated by Google) Something' || chr(10) || chr(10) || '(Original)' ELSE own END AS original FROM t""")
def original_comments(spark, d):
    """The reviewer's own words: of every third comment from behind its translation, else the comment itself."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    comment = F.when(i % 3 == 0, F.concat(F.lit("(Translated by Google) Something\n\n(Original)\n"), text)).otherwise(text)
    return views.table(spark, d, "documents").select(i.alias("id"), S.original_comment(comment).alias("original"))


# ---- artifacts ------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT s_suppkey % 7 AS project, s_suppkey, length(s_name) AS bytes FROM supplier)
SELECT project, count(*) AS objects, sum(bytes)::BIGINT AS bytes FROM o WHERE NOT (project = 3) AND NOT (project = 5 AND s_suppkey % 2 = 0) GROUP BY project""")
def artifacts_left(spark, d):
    """Objects of imports by project, after one project's were deleted and one kind of another's."""
    store = ArtifactStore(spark, fresh_path(spark, "artifacts"))
    i = F.col("s_suppkey")
    kind = F.when(i % 2 == 0, "errors").otherwise("plan")
    key = F.concat((i % 7).cast("string"), F.lit("/"), kind, F.lit("/"), i.cast("string"), F.lit(".csv"))
    store.put(views.table(spark, d, "supplier").select(key.alias("key"), F.encode("s_name", "UTF-8").alias("content")))
    store.delete("3/")
    store.delete("5/errors/")
    project = F.substring_index("key", "/", 1).cast("bigint")
    return store.listed().groupBy(project.alias("project")).agg(F.count(F.lit(1)).alias("objects"), F.sum("bytes").alias("bytes"))
