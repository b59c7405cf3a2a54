import json

import pytest
from pyspark.sql import functions as F

from almanac.operators.reports import bucket_counts, retention_plan
from almanac.sinks import writers
from almanac.sources import readers


def test_readers(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text('{" k1 ": 5, "": 1, "k2": "x", "k3": -2}')
    (tmp_path / "m" / "b.json").write_text("[1, 2]")
    m = readers.json_map(spark, str(tmp_path / "m"))
    assert {(r["key"], r["value"]) for r in m.collect()} == {("k1", "5"), ("k2", "x"), ("k3", "-2")}
    assert {(r["key"], r["failures"]) for r in readers.clean_counters(m, True).collect()} == {("k1", 5), ("k3", -2)}
    assert {(r["key"], r["failures"]) for r in readers.clean_counters(m, False).collect()} == {("k1", 5), ("k2", 0), ("k3", 0)}
    (tmp_path / "log.json").write_text('[{"key": "a", "status": "ok"}, {"key": "b"}]')
    assert [(r["seq"], r["key"], r["status"]) for r in readers.json_rows(spark, str(tmp_path / "log.json"), "key string, status string").orderBy("seq").collect()] == [(0, "a", "ok"), (1, "b", None)]
    for d, n in (("", "k"), ("north/", "k"), ("west/", "k"), ("", "z")):
        (tmp_path / "r" / d).mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / d / f"{n}.json").write_text(json.dumps({"status": d or "flat"}))
    got = {(r["key"], r["status"]) for r in readers.json_file_per_key(spark, [str(tmp_path / "r" / x) for x in ("*.json", "*/*.json")], "status string").collect()}
    assert got == {("k", "north/"), ("z", "flat")}
    inv = readers.file_inventory(spark, str(tmp_path / "m"))
    assert inv.count() == 2 and inv.agg(F.sum("bytes")).first()[0] == sum(p.stat().st_size for p in (tmp_path / "m").iterdir())
    named = readers.named_files(spark.createDataFrame([("x/derry-2026-06-14.html",), ("x/index.html",)], "path string"), r"^([a-z]+)-(\d{4}-\d{2}-\d{2})\.html$", ["group", "day"])
    assert [(r["group"], r["day"]) for r in named.collect()] == [("derry", "2026-06-14")]


def test_report(spark):
    rows = spark.createDataFrame([(2, "w", "downloaded", "b"), (1, "w", "downloaded", "a"), (3, "w", "failed", "c")], "row_id long, week string, bucket string, parish string")
    r = json.loads(writers.report_json(rows, ["week"]).first()["json"])
    assert r["summary"] == {"downloaded": 2, "html_links": 0, "skipped": 0, "failed": 1, "stale_rejected": 0} and [x["parish"] for x in r["downloaded"]] == ["a", "b"] and r["skipped"] == []
    assert "downloaded             2" in writers.report_text(bucket_counts(rows, ["week"]), ["week"]).first()["text"]


def test_calendar_and_feed(spark, tmp_path):
    e = spark.createDataFrame([("g", "k", 2, "Tea, cake; fun", "2026-06-14", "9:5", "Hall", "", "social"), ("g", "k", 1, "All day", "2026-06-15", None, None, "x\ny", None), ("g", "k", 3, "Bad", "2026-02-31", None, None, None, None)],
                              '`group` string, key string, seq int, title string, date_iso string, time_24h_or_null string, location_or_null string, description string, category string')
    stamp = F.lit("2026-06-01 10:00:00+00:00").cast("timestamp")
    writers.write_calendars(writers.calendars(e, stamp), str(tmp_path / "ics"))
    got = {d.name.removeprefix("group="): b"".join(f.read_bytes() for f in sorted(d.glob("part-*"))).decode() for d in (tmp_path / "ics").glob("group=*")}
    assert set(got) == {"g", "all"} and got["g"].count("BEGIN:VEVENT") == 2
    body = got["g"]
    assert "DTSTART:20260614T090500" in body and "DTSTART;VALUE=DATE:20260615" in body and "SUMMARY:Tea\\, cake\\; fun" in body and "DESCRIPTION:x\\ny" in body and "CATEGORIES:SOCIAL" in body
    assert body.index("All day") < body.index("Tea") and body.endswith("END:VCALENDAR\r\n") and "DTSTAMP:20260601T100000Z" in body
    g = spark.createDataFrame([("n", "A & B", "https://x/?a=1&b=2", "2026-06-14", "66.7%")], "name string, title string, link string, day string, rate string")
    xml = writers.rss(g, stamp).first()["xml"]
    import xml.etree.ElementTree as ET

    item = ET.fromstring(xml.encode()).find("channel/item")
    assert item.find("link").text == "https://x/?a=1&b=2" and item.find("guid").text.endswith("#2026-06-14") and item.find("pubDate").text == "Mon, 01 Jun 2026 10:00:00 +0000"


def test_search_index_is_the_newest_prefix(spark):
    docs = spark.createDataFrame([("d", f"2026-06-{i:02d}", f"k{i}", "P", "é" * 100) for i in range(1, 29)] + [("d", "2026-07-01", "x", "P", "")], "diocese string, day string, key string, parish string, text string")
    rows = writers.search_documents(docs)
    assert rows.count() == 28
    out = [r["date"] for r in writers.search_index(rows, cap=3000).orderBy("rank").collect()]
    assert out == sorted(out, reverse=True) and out[0] == "2026-06-28" and 8 <= len(out) <= 12


def test_retention(spark):
    f = spark.createDataFrame([("a/1.pdf", 5, "2026-01-10", "individual"), ("a/2.pdf", 5, "2026-05-30", "individual"), ("a/3.pdf", 5, "2026-02-10", "individual"), ("z/2026-02-individual-pdfs.zip", 9, "2026-03-01", "archive"), ("z/2023-01-individual-pdfs.zip", 9, "2023-02-01", "archive")], "path string, bytes int, m string, kind string")
    f = f.select("path", "bytes", F.col("m").cast("timestamp").alias("modified"), "kind")
    got = {r["path"]: r["action"] for r in retention_plan(f, F.lit("2026-06-14").cast("timestamp")).collect()}
    assert got == {"a/1.pdf": "zip", "a/2.pdf": "keep", "a/3.pdf": "delete", "z/2026-02-individual-pdfs.zip": "keep", "z/2023-01-individual-pdfs.zip": "delete"}


def test_retention_of_merged_files_and_cap(spark):
    f = [("m/1.pdf", 5, "2026-03-30", "merged"), ("m/2.pdf", 5, "2026-02-10", "merged"), ("z/2024-07-individual-pdfs.zip", 40, "2024-08-01", "archive"), ("z/2024-09-individual-pdfs.zip", 40, "2024-10-01", "archive"), ("z/2025-09-individual-pdfs.zip", 40, "2025-10-01", "archive")]
    df = spark.createDataFrame(f, "path string, bytes int, m string, kind string").select("path", "bytes", F.col("m").cast("timestamp").alias("modified"), "kind")
    plan = lambda cap: {r["path"].split("/")[1][:7]: r["action"] for r in retention_plan(df, F.lit("2026-06-14").cast("timestamp"), cap=cap).collect()}
    assert plan(None) == plan(1000) == {"1.pdf": "keep", "2.pdf": "zip", "2024-07": "keep", "2024-09": "keep", "2025-09": "keep"}
    assert plan(95) == {"1.pdf": "keep", "2.pdf": "zip", "2024-07": "prune", "2024-09": "keep", "2025-09": "keep"}
    assert plan(60) == {"1.pdf": "keep", "2.pdf": "zip", "2024-07": "prune", "2024-09": "prune", "2025-09": "keep"}
    assert plan(1)["2025-09"] == "prune" and plan(1)["1.pdf"] == "keep"


@pytest.mark.parametrize("kind", ["json", "text"])
def test_writing_per_group(spark, tmp_path, kind):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "g string, v string")
    if kind == "json":
        writers.write_per_group(df, str(tmp_path / "o"), "g")
        assert {(r["g"], r["v"]) for r in spark.read.json(str(tmp_path / "o")).collect()} == {("a", "x"), ("b", "y")}
    else:
        writers.write_texts(df, str(tmp_path / "o"), "g", "v")
        assert {r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()} == {"x", "y"}
