import json
import zipfile

import pytest

from marlstone.functions import scalar as S
from marlstone.sources import files, mapping, tables
from pyspark.sql import functions as F


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("cell, want", [("5", 5), (" 4 stars", 4), ("★★★☆☆", 3), ("***", 3), ("4/5", 4), ("7 out of 10", 4), ("9", 5), ("7,5", 4), ("rated 3", 3), ("Four-Stars", 4), ("0", None), ("11", None), ("", None), ("good", None), ("6/5", None), ("1/0", None), ("2.5", 3), ("☆☆", None)])
def test_ratings(spark, cell, want):
    assert one(spark, S.parse_rating, cell) == want


@pytest.mark.parametrize("cell, want", [
    ("2026-01-05", "2026-01-05T00:00:00.000Z"), ("2026-01-05T10:20:30.5Z", "2026-01-05T10:20:30.500Z"), ("2026-01-05 10:20 +02:00", "2026-01-05T08:20:00.000Z"), ("2026-01-05T10:20-0530", "2026-01-05T15:50:00.000Z"), ("1/5/26", "2026-01-05T00:00:00.000Z"),
    ("1/5/2026 12:05 am", "2026-01-05T00:05:00.000Z"), ("1/5/2026, 3:04:05 p.m.", "2026-01-05T15:04:05.000Z"), ("5.1.2026", "2026-01-05T00:00:00.000Z"), ("Jan 5, 2026 at 3:04 PM", "2026-01-05T15:04:00.000Z"), ("Monday, January 5th 2026", "2026-01-05T00:00:00.000Z"), ("5 Sept 2026", "2026-09-05T00:00:00.000Z"),
    ("1767571200", "2026-01-05T00:00:00.000Z"), ("1767571200000", "2026-01-05T00:00:00.000Z"), ("2026-02-30", None), ("13/1/2026", None), ("1/5/2026 25:00", None), ("Foo 5, 2026", None), ("soon", None), ("", None), ("4102444800000", "2100-01-01T00:00:00.000Z"), ("9999999999999", None),
])
def test_dates(spark, cell, want):
    assert one(spark, S.parse_date, cell) == want


@pytest.mark.parametrize("f, cell, want", [
    (S.normalize_source, " Google Maps", "google"), (S.normalize_source, "FB", "facebook"), (S.normalize_source, "blog", "custom"), (S.metadata_key, "  Größe (cm) ", "gr_e_cm"), (S.metadata_key, "!!", "column"), (S.header_key, "Star  Rating!", "star rating"), (S.slugify, "Café Ünïcode & Co.", "cafe-unicode-co"),
    (S.original_comment, "(Translated by Google) Hi\n\n(Original)\nHola", "Hola"), (S.original_comment, " plain ", "plain"), (S.category_from_type, "gcid:Dental_Clinic", "dental"), (S.category_from_type, "thai_restaurant", "restaurant"), (S.category_from_type, "zoo", None),
    (S.origin, "HTTPS://Shop.example:443/", "https://shop.example"), (S.origin, "http://a.b:8080", "http://a.b:8080"), (S.origin, "ftp://a", None), (S.review_suffix, "accounts/1/locations/2/reviews/3", "locations/2/reviews/3"), (S.location_id, "x", None), (S.escape_like, "5%_\\", "5\\%\\_\\\\"),
    (lambda c: S.short_excerpt(c, 10), "one two three four", "one two…"), (lambda c: S.short_excerpt(c, 10), "abcdefghijklmnop", "abcdefghij…"), (S.source_name, "custom", None), (S.source_name, "zomato", "Zomato"), (S.rating_from_stars, "FOUR", 4),
])
def test_scalars(spark, f, cell, want):
    assert one(spark, f, cell) == want


TRICKY = '﻿review_id,reviewer,comment\r\n1,"Ann ""A""","line one\nline two"\r\n\r\n2,B"ob,plain\r3,,"open'


def test_csv_however_it_is_cut():
    want = [["review_id", "reviewer", "comment"], ["1", 'Ann "A"', "line one\nline two"], ["2", 'B"ob', "plain"], ["3", "", "open"]]
    for n in (1, 2, 3, 7, 1000):
        r = files.Records()
        got = [row for k in range(0, len(TRICKY), n) for row in r.write(TRICKY[k : k + n])] + [*r.end()]
        assert got == want
    assert files.parse_csv("a;b\n1;2,3\n") == (["a", "b"], [["1", "2,3"]])
    assert files.detect_delimiter('"a,b,c";d;e') == ";" and files.detect_delimiter("abc") == ","
    assert files.parse_csv("") == ([], [])


def test_large_csv_files_are_read_line_by_line(spark, tmp_path):
    quoted = lambda s: '"' + s.replace('"', '""') + '"'
    rows = [[f"r{i}", "one, two" if i % 3 else "line\n\nlines " * 40, f'say "{i}"'] for i in range(2000)]
    (tmp_path / "a.csv").write_text("id,text,said\r\n" + "\n".join(",".join(map(quoted, r)) + ("\n\n" if i % 500 == 7 else "") for i, r in enumerate(rows)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)
    try:
        got = files.csv_rows(spark, str(tmp_path / "a.csv"))
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 4
        assert [(r.row, r.cells) for r in sorted(got.collect(), key=lambda r: r.row)] == [(i + 1, r) for i, r in enumerate(rows)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_tables():
    headers, rows = files.parse_json_table(json.dumps({"x": 1, "reviews": [{"a": {"b": 1.0}, "c": [1, "é"]}, {"d": None, "a": True}]}))
    assert headers == ["a.b", "c", "d", "a"] and rows == [["1", '[1,"é"]', "", ""], ["", "", "", "true"]]
    assert files.parse_json_table('[{"a": "x"}]') == (["a"], [["x"]])
    for bad in ("{", "1", "[1]", '{"a": [], "b": []}'):
        with pytest.raises(files.ShapeError):
            files.parse_json_table(bad)


def test_uploads_to_reviews(spark, tmp_path):
    (tmp_path / "g.csv").write_text("Review ID,Reviewer Name,Star Rating,Review Text,Review Date,Location Name\nr1,Ann,5,Lovely place to be,2026-01-05,North\nr2,,x,Fine but slow service here,2026-01-06,\n,Cy,3,It was what it was,Jan 7 2026,South\n")
    cells = files.csv_cells(spark, str(tmp_path / "g.csv")).cache()
    headers = cells.first().headers
    m = mapping.detect(headers, cells)
    assert m.profile == "google-business-profile" and m.fields["text"] == "Review Text" and m.metadata == {"Location Name": "location"} and m.unmapped(headers) == []
    rows = {r.row: r for r in mapping.normalize(cells, headers, m, "google").collect()}
    assert rows[1].ok and rows[1].review.rating == 5 and rows[1].review.metadata == {"location": "North"} and rows[1].review.occurred_at == "2026-01-05T00:00:00.000Z"
    assert not rows[2].ok and [e.field for e in rows[2].errors] == ["rating"] and list(rows[2].warnings) == ["author"]
    assert rows[3].review.external_id and len(rows[3].review.external_id) == 40
    s = mapping.summary(mapping.normalize(cells, headers, m)).first()
    assert (s.total, s.valid, s.invalid) == (3, 2, 1)
    assert files.read_csv(spark, str(tmp_path / "g.csv")).count() == 3
    files.error_report(spark.createDataFrame([(2, 'bad "x"')], "row int, reason string"), str(tmp_path / "report"))
    assert next((tmp_path / "report").glob("part*")).read_bytes() == b'"row","reason"\r\n"2","bad ""x"""\r\n'


def test_columns_are_found_by_their_values(spark):
    rows = [(i, [f"id{i}", f"2026-01-{i + 1:02}", str(1 + i % 5), "a text that is long enough to be one", "http://x.y/"]) for i in range(9)]
    cells = spark.createDataFrame(rows, "row bigint, cells array<string>")
    m = mapping.detect(["c1", "c2", "c3", "c4", "link"], cells)
    assert m.profile == "generic" and m.fields == {"occurred_at": "c2", "rating": "c3", "text": "c4", "url": "link"}


def page(*reviews):
    return json.dumps({"reviews": list(reviews)})


def review(n, **more):
    return {"name": f"accounts/1/locations/7/reviews/{n}", "reviewer": {"displayName": f"P{n}"}, "starRating": "FIVE", "comment": f"words {n}", "createTime": "2026-01-05T10:00:00Z", **more}


def test_export_archives(spark, tmp_path):
    base = "Takeout/Google Business Profile/account-1/location-7"
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr(f"{base}/reviews.json", page(review(1), review(2, comment=None), {"name": "odd"}))
        z.writestr(f"{base}/reviews-2.json", page(review(1, comment="edited", updateTime="2026-02-01T00:00:00Z", reviewReply={"comment": " thanks "})))
        z.writestr(f"{base}/additionalData.json", json.dumps({"attributes": [{"id": {"attributeType": "LISTING_NAME"}, "values": [{"datum": {"listingName": {"text": " The Shop "}}}]}]}))
        z.writestr("Takeout/Maps (your places)/Reviews.json", "{}")
        z.writestr("Takeout/other.json", "{}")
    entries = files.archive_entries(spark, str(tmp_path))
    assert sorted(r.k for r in entries.select(files.entry_kind("path").alias("k")).collect()) == ["location-data", "maps-reviews", "reviews", "reviews"]
    reviews = mapping.takeout_reviews(entries)
    got = {r.suffix[-1]: r for r in mapping.map_takeout(reviews).collect()}
    assert got["1"].status == "ok" and got["1"].review.text == "edited" and got["1"].review.rating == 5 and got["1"].seen == 2
    assert got["1"].review.metadata["location_title"] == "The Shop" and got["1"].review.metadata["owner_reply"] == "thanks" and got["2"].status == "star_only"
    r = mapping.export_as_of(reviews).first()
    assert r.duplicates == 1 and r.as_of_ms == 1769904000000


def test_business_and_places_reviews(spark):
    raw = [{"name": "a/1", "reviewer": {"isAnonymous": True, "displayName": "x"}, "starRating": "TWO", "comment": " ok ", "createTime": "2026-01-05T10:00:00Z", "updateTime": "2026-01-06T10:00:00Z"}, {"name": "a/2", "starRating": "ONE", "createTime": "2026-01-05T10:00:00Z", "updateTime": "2026-01-05T10:00:00Z"}, {"name": "a/3", "starRating": "SIX", "comment": "x"}]
    got = {r.name: r for r in mapping.map_business(spark.createDataFrame([(json.dumps(x),) for x in raw], "json string"), {"id": "L", "title": "T"}).collect()}
    assert [got[f"a/{i}"].status for i in (1, 2, 3)] == ["ok", "star_only", "invalid"] and got["a/1"].review.author_name == "A Google user" and got["a/1"].review.rating == 2
    place = {"id": "p", "displayName": {"text": " "}, "reviews": [{"name": "r1", "rating": 4, "originalText": {"text": "hola", "languageCode": "es"}, "publishTime": "2026-01-05T10:00:00Z"}, {"name": "r2", "rating": 1, "publishTime": "2026-01-05T10:00:00Z"}]}
    got = {r.name: r for r in mapping.map_places(spark.createDataFrame([(json.dumps(place),)], "json string")).collect()}
    assert got["r1"].review.language == "es" and got["r1"].review.metadata["place_name"] == "Unnamed place" and got["r2"].status == "star_only"


def test_locations(spark):
    accounts = spark.createDataFrame([("acc", [("l1", "A", ["1 Road", " "], "Town", None, "99", True), ("l2", None, None, None, None, None, None)])], "name string, locations array<struct<name:string,title:string,addressLines:array<string>,locality:string,administrativeArea:string,postalCode:string,verified:boolean>>")
    found = mapping.discover_locations(accounts)
    assert {r.id: r.address for r in found.collect()} == {"l1": "1 Road, Town, 99", "l2": None}
    assert {r.id: r.enabled for r in mapping.select_locations(found, ["l1", "l2"]).collect()} == {"l1": True, "l2": False}
    assert {r.id: r.enabled for r in mapping.merge_locations(found, mapping.select_locations(found, ["l1"])).collect()} == {"l1": True, "l2": False}


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "live", "a"), (2, "test", "b")], "project_id int, environment string, v string")
    tables.store(rows, str(tmp_path / "t"))
    got = tables.scan(spark, str(tmp_path / "t"), 1, "live")
    assert [r.v for r in got.collect()] == ["a"] and "PartitionFilters: [isnotnull(project_id" in got._jdf.queryExecution().executedPlan().toString()
    tables.swap(rows, str(tmp_path / "s"))
    again = spark.read.parquet(str(tmp_path / "s"))
    tables.swap(again.filter("project_id = 1"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1 and tables.healthy(spark)


@pytest.mark.parametrize("stop", range(5))
def test_a_parted_table_swapped_as_a_whole_has_only_the_new_rows(spark, tmp_path, monkeypatch, stop):
    """Stopped before each step of a replacement whose new rows lack a partition of the old."""
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(p, "live", v) for p in (1, 2) for v in "abc"], "project_id int, environment string, v string")
    tables.store(rows, path)
    real, left = tables._files, [stop]

    class Breaks:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            def call(*a):
                if name in ("rename", "delete", "mkdirs"):
                    if not left[0]:
                        raise OSError("gone")
                    left[0] -= 1
                return getattr(self.fs, name)(*a)

            return call

    monkeypatch.setattr(tables, "_files", lambda s, p: (lambda fs, at: (Breaks(fs), at))(*real(s, p)))
    new = spark.read.parquet(path).filter("project_id = 1")
    try:
        tables.swap(new, path)
        broken = False
    except OSError:
        broken = True
    monkeypatch.setattr(tables, "_files", real)
    tables.recover(spark, path)
    got = spark.read.parquet(path)
    assert got.count() == (6 if broken and stop == 0 else 3 if not broken or stop > 1 else got.count())
    assert got.count() in (3, 6) and tables.parted_by(spark, path) == ["project_id", "environment"]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_csv_files_are_parsed_in_parts_as_a_whole(monkeypatch):
    """However a file is cut, also within characters, line ends and quotes; and no part has all of its rows."""
    text = "\ufeffid;text\r\n1;\"a\nb;\"\"é\"\"\"\r\n\r\n2;日本\r3;\"open"
    for size in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(files, "PART", size)
        parts = list(files.csv_parts(text.encode()))
        assert [r for _, rows in parts for r in rows] == files.parse_csv(text)[1] and all(h == ["id", "text"] for h, _ in parts)
    monkeypatch.setattr(files, "PART", 1000)
    parts = list(files.csv_parts(("n,t\n" + "".join(f"{i},{'x' * 50}\n" for i in range(400))).encode()))
    assert sum(len(rows) for _, rows in parts) == 400 and max(len(rows) for _, rows in parts) < 40
    assert list(files.csv_parts(b"")) == [] and list(files.csv_parts("\ufeff".encode())) == []
