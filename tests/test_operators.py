"""Operators against row-by-row folds and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from almanac.functions import predicates as P
from almanac.functions.pages import RuleSet, page_type
from almanac.operators import calendar, lookups, order, ranking, recipes, reports, sections, state
from almanac.operators.orphans import Edge, direct_orphans, orphan_cascade
from almanac.operators.snapshots import change_counts, snapshot_changes
from almanac.session import norm_key

SNAP = "station string, day date, parish string, url string, file string, delivered int, row_id long"


def brute_changes(rows):
    last = {}
    snaps = {}
    for st, d, k, u, f, at, i in rows:
        if st is None or d is None:
            continue
        snaps.setdefault(st, set()).add(d)
        if k is None:
            continue
        key = (st, d, k.strip().lower())
        rank = (at is not None, at or 0, i)
        if key not in last or rank > last[key][0]:
            last[key] = (rank, (u, f))
    out = set()
    for st, ds in snaps.items():
        ds = sorted(ds)
        for a, b in zip(ds, ds[1:], strict=False):
            old = {k: v[1] for (s, d, k), v in last.items() if s == st and d == a}
            new = {k: v[1] for (s, d, k), v in last.items() if s == st and d == b}
            out |= {(st, b, k, "added") for k in new.keys() - old.keys()} | {(st, b, k, "removed") for k in old.keys() - new.keys()}
            out |= {(st, b, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    return out


def test_snapshot_changes_against_brute_force(spark):
    import datetime as dt

    rng = random.Random(1)
    rows = []
    for i in range(600):
        d = dt.date(2025, 1, 1) + dt.timedelta(days=7 * rng.randint(0, 6))
        rows.append((rng.choice(["a", "b", "hot", "hot", None]), rng.choice([d] * 9 + [None]), rng.choice(["k1", " K1", "k2 ", "k3", "", None]), rng.choice(["u", "v", None]), rng.choice(["f", None]), rng.choice([1, 2, None]), i))
    df = spark.createDataFrame(rows + rows[:50], SNAP).selectExpr("*", "'x' AS change", "1 AS _k")
    got = snapshot_changes(df, "station", "day", "parish", ["url", "file"], ["delivered", "row_id"])
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_changes(rows)
    n = change_counts(got, "station", "day").agg(F.sum(F.col("added") + F.col("removed") + F.col("changed"))).first()[0]
    assert n == len(found)
    hot = snapshot_changes(df, "station", "day", "parish", ["url", "file"], ["delivered", "row_id"], hot_rows=3)
    assert sorted(map(tuple, hot.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    assert snapshot_changes(df.limit(0), "station", "day", "parish", ["url"], ["row_id"]).count() == 0


def test_cascade_down_four_levels_against_recursive_sql(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(12)
    levels = {f"l{n}": pd.DataFrame([(i, f"l{n}-{i}", None if rng.random() < 0.1 else f"l{n - 1}-{rng.randint(0, 44)}") for i in range(40)], columns=["row_id", "k", "ref"]) for n in range(1, 5)}
    levels["l0"] = pd.DataFrame({"k": [f"l0-{i}" for i in range(25)]})
    con = duckdb.connect()
    con.register("n", pd.concat([d.assign(t=t) for t, d in levels.items()]))
    want = con.execute("""WITH RECURSIVE o AS (SELECT t, row_id, k, 0 AS depth FROM n WHERE ref IS NOT NULL AND ref NOT IN (SELECT k FROM n) UNION ALL SELECT n.t, n.row_id, n.k, depth + 1 FROM n JOIN o ON n.ref = o.k)
     SELECT t, CAST(row_id AS BIGINT), CASE depth WHEN 0 THEN 'direct' ELSE 'inherited' END, depth FROM o""").fetchall()
    nodes = {t: spark.createDataFrame(d.astype(object).where(d.notna(), None), "k string" if t == "l0" else "row_id long, k string, ref string") for t, d in levels.items()}
    edges = [Edge(f"l{n}", ["ref"], f"l{n - 1}", ["k"]) for n in range(1, 5)]
    got = orphan_cascade(nodes, edges)
    assert sorted((r["table_name"], r["row_id"], r["kind"], r["depth"]) for r in got.collect()) == sorted(want)
    assert {d for *_, d in want} == {0, 1, 2, 3}


def test_direct_orphans(spark):
    child = spark.createDataFrame(
        [(1, "a", "2025-01-10"), (2, "a", "2024-01-10"), (3, "b", "2025-01-10"), (4, None, "2025-01-10"), (5, "a", None), (6, "a", "2025-02-01"), (3, "b", "2025-01-10")], "row_id long, k string, d string"
    ).selectExpr("row_id", "k", "date(d) AS day", "'x' AS _p0", "1 AS _from")
    parent = spark.createDataFrame([("a", "2025-01-01", "2025-02-01"), ("a", "2025-01-01", "2025-02-01"), ("c", None, None), (None, None, None)], "k string, f string, t string").selectExpr("k", "date(f) AS f", "date(t) AS t")
    e = Edge("c", ["k"], "p", ["k"], child_day="day", valid_from="f", valid_to="t")
    assert sorted(r["row_id"] for r in direct_orphans(child, parent, e).collect()) == [2, 3, 3, 5, 6]
    assert direct_orphans(child, parent.limit(0), e).count() == 6 and direct_orphans(child.limit(0), parent, e).count() == 0


def test_cascade(spark):
    ids = lambda rows: spark.createDataFrame(rows, "row_id long, k string, ref string")
    nodes = {
        "root": spark.createDataFrame([("r1",)], "k string"),
        "a": ids([(1, "a1", "r1"), (2, "a2", "gone"), (3, "a3", None), (4, "both", "gone"), (5, "both", "r1")]),
        "b": ids([(10, "b1", "a1"), (11, "b2", "a2"), (12, "b3", "nowhere"), (13, "b4", "both")]),
        "c": ids([(20, "c1", "b2"), (21, "c2", "b3"), (22, "c3", "b1")]),
    }
    edges = [Edge("a", ["ref"], "root", ["k"]), Edge("b", ["ref"], "a", ["k"]), Edge("c", ["ref"], "b", ["k"])]
    got = {(r["table_name"], r["row_id"], r["kind"], r["depth"]) for r in orphan_cascade(nodes, edges).collect()}
    assert got == {("a", 2, "direct", 0), ("a", 4, "direct", 0), ("b", 12, "direct", 0), ("b", 11, "inherited", 1), ("c", 21, "inherited", 1), ("c", 20, "inherited", 2)}


def test_deep_cascade(spark, monkeypatch):
    monkeypatch.setattr("almanac.operators.orphans.GATHER", 2)
    nodes = {"t": spark.createDataFrame([(i, f"k{i}", f"k{i - 1}") for i in range(1, 6)], "row_id long, k string, ref string").coalesce(1)}
    edge = Edge("t", ["ref"], "t", ["k"])
    assert {(r["row_id"], r["depth"]) for r in orphan_cascade(nodes, [edge]).collect()} == {(i, i - 1) for i in range(1, 6)}
    with pytest.raises(ValueError):
        orphan_cascade(nodes, [edge], max_rounds=2)


def test_failures_strikes_and_confidence_against_folds(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.choice(["ok", "error", "error", "html_link", "skipped", None])) for i in range(120)]
    prior = {"a": 4, "d": 7, "e": -2}
    want = {k: max(0, v) for k, v in prior.items()}
    for _, k, s in rows:
        want[k] = 0 if s in P.FINE else want.get(k, 0) + 1
    batch = spark.createDataFrame(rows, "seq long, key string, status string")
    got = state.consecutive_failures(batch, spark.createDataFrame(list(prior.items()), "key string, failures int"))
    assert {r["key"]: r["failures"] for r in got.collect()} == want

    probes = [(i, rng.choice("abcd"), rng.choice(["ok", "nxdomain", "error"])) for i in range(60)] + [(100, "e", "error"), (101, "f", "error"), (102, "g", "nxdomain")]
    old = {"a": (1, "nxdomain_watch"), "e": (3, "inactive_candidate"), "g": (1, "nxdomain_watch")}
    fold = {k: list(v) for k, v in old.items()}
    for _, k, r in probes:
        e = fold.setdefault(k, [0, "unknown"])
        if r == "ok":
            e[:] = [0, "ok"]
        elif r == "nxdomain":
            e[:] = [e[0] + 1, "inactive_candidate" if e[0] + 1 >= 2 else "nxdomain_watch"]
    got = state.strikes(spark.createDataFrame(probes, "seq long, key string, result string"), spark.createDataFrame([(k, *v) for k, v in old.items()], "key string, strikes int, status string"))
    assert {r["key"]: [r["strikes"], r["status"]] for r in got.collect()} == {k: v for k, v in fold.items() if k in {p[1] for p in probes}}

    seen = [(i, rng.choice("ab"), rng.choice(["u", "v"])) for i in range(40)]
    run = {}
    for _, k, u in seen:
        run[k] = (u, run[k][1] + 1) if k in run and run[k][0] == u else (u, 1)
    got = state.confidence(spark.createDataFrame(seen, "seq long, key string, new_url string"))
    assert {r["key"]: (r["new_url"], r["confidence"]) for r in got.collect()} == run


def test_merges_and_outcomes(spark):
    old = spark.createDataFrame([("a", "x", "y"), ("b", "z", None)], "key string, name string, note string")
    new = spark.createDataFrame([("a", " ", "n"), ("c", "q", None)], "key string, name string, note string")
    assert {tuple(r) for r in state.merged_records(old, new, "key", ["name", "note"]).collect()} == {("a", "x", "n"), ("b", "z", None), ("c", "q", None)}
    att = spark.createDataFrame([("a", 1, "error", "e1"), ("a", 2, "ok", "u2"), ("a", 3, "ok", "u3"), ("b", 1, "error", "e1"), ("b", 2, "error", "e2")], "key string, step int, status string, what string")
    assert {(r["key"], r["what"]) for r in state.first_outcome(att, ["key"], ["status", "what"]).collect()} == {("a", "u2"), ("b", "e2")}
    recipes = spark.createDataFrame([("a", True, None), ("b", None, "Dead_URL"), ("c", False, "active")], "key string, skip boolean, status string")
    counters = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "key string, failures int")
    assert {r["key"] for r in state.pruned(counters, recipes).collect()} == {"c", "d"}


def test_global_order(spark):
    rng = random.Random(8)
    vals = [(i, rng.randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(vals, "id long, v long")
    out = sorted((r["rank"], r["running"], r["id"]) for r in order.with_global_prefix(df, [F.desc("v"), F.col("id")], "v", partitions=7).collect())
    want, total = [], 0
    for n, (i, v) in enumerate(sorted(vals, key=lambda x: (-x[1], x[0])), 1):
        total += v
        want.append((n, total, i))
    assert out == want
    assert order.with_global_prefix(df.limit(0), [F.col("id")], "v").count() == 0
    keys = spark.createDataFrame(list(enumerate(["zulu", "bravo", "charlie", "alpha", "yankee"])), "seq int, key string")
    fails = spark.createDataFrame([("alpha", 2), ("bravo", 2), ("charlie", 5), ("zulu", None)], "key string, failures int")
    assert [r["key"] for r in order.priority_order(keys, fails).orderBy("rank").collect()] == ["charlie", "alpha", "bravo", "zulu", "yankee"]


def test_reports(spark):
    rows = spark.createDataFrame(
        [(1, "w", "a", "downloaded", None), (2, "w", "a", "failed", None), (3, "w", "b", "failed", None), (4, "w", "b", "failed", None), (5, "w", "c", "failed", None), (6, "w", "a", "html_links", None), (7, "w", "", "failed", None), (8, "w", "d", "skipped", "s"), (9, "w", "d", "failed", None)],
        "row_id long, week string, parish string, bucket string, reason string",
    )
    recipes = spark.createDataFrame([("b", False, "inactive", " gone "), ("d", True, None, None)], "key string, skip boolean, status string, reason string")
    got = {(r["row_id"], r["bucket"], r["reason"]) for r in reports.reconciled(rows, recipes, ["week"]).collect()}
    assert got == {(1, "downloaded", None), (3, "skipped", "gone"), (5, "failed", None), (8, "skipped", "s")}
    patch = rows.where("row_id = 5").withColumn("bucket", F.lit("downloaded")).unionByName(rows.where("row_id = 5").withColumn("row_id", F.lit(99).cast("long")))
    assert {(r["row_id"], r["parish"]) for r in reports.patched(rows, patch, ["week"]).collect()} == {(99, "c")} | {(r["row_id"], r["parish"]) for r in rows.where("parish <> 'c'").collect()}
    counts = reports.success_rates(reports.bucket_counts(rows, ["week"])).first()
    assert counts["downloaded"] == 1 and counts["failed"] == 6 and counts["stale_rejected"] == 0 and counts["rate"] == pytest.approx(100 / 7) and counts["rate_with_links"] == 12.5
    res = spark.createDataFrame([("k", 1, "error"), ("k", 2, "ok"), ("k", 3, "html_link"), ("k", 4, "error"), ("m", 1, "skipped"), ("m", 2, "error")], "key string, seq int, status string")
    assert {(r["key"], r["seq"]) for r in reports.one_result_per_key(res, ["key"], "seq", ["seq", "status"]).collect()} == {("k", 3), ("m", 1)}


def test_weekly_bins_are_half_open(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    log = spark.createDataFrame([("2026-01-31 00:00:00", True), ("2026-02-01 12:00:00", True), ("2026-02-02 00:00:00", True), ("2026-01-25 00:00:00", False), ("2025-12-07 00:00:00", True), ("2025-12-06 23:59:59", True)], "s string, ok boolean")
    log = log.select(F.col("s").cast("timestamp").alias("ts"), "ok")
    got = {r["week"]: (r["total"], r["rate"]) for r in reports.weekly_rates(log, "ts", F.col("ok"), t("2026-02-01 00:00:00")).collect()}
    assert got[7] == (3, pytest.approx(200 / 3)) and got[0] == (1, 100.0) and got[3] == (0, None) and len(got) == 8


def test_lookups(spark):
    s = spark.createDataFrame([(1, "kilmore", "Kilmore Parish"), (2, "other", "St Ann's")], "seq int, key string, name string")
    al = lookups.alias_map(s, "key", "name", "seq")
    rows = spark.createDataFrame([("KILMORE!",), ("kilmore parish",), ("st. anns",), ("new one",)], "n string")
    assert sorted(r["resolved"] for r in lookups.resolved_names(rows, al, "n").collect()) == ["kilmore", "kilmore", "newone", "other"]
    q = spark.createDataFrame([("Saint Anns",), ("Kilmo",), ("zzz",), ("Parish",)], "query string")
    e = spark.createDataFrame([("Kilmore Parish",), ("St Ann's",), ("Derry Parish",)], "name string")
    assert {r["query"]: r["outcome"] for r in lookups.name_match(q, e).collect()} == {"Saint Anns": "exact", "Kilmo": "partial", "zzz": "none", "Parish": "ambiguous"}
    prof = spark.createDataFrame([("www.a.ie", 9), ("b.ie", 8)], "host string, wait int")
    urls = spark.createDataFrame([("https://a.ie/x",), ("https://www.b.ie/",), ("https://c.ie",)], "url string")
    assert {r["url"]: r["wait"] for r in lookups.host_settings(urls, prof, "url", {"wait": 1}).collect()} == {"https://a.ie/x": 9, "https://www.b.ie/": 8, "https://c.ie": 1}
    ed = spark.createDataFrame([("p", "2026-06-14", 1), ("p", "2026-06-08", 2), ("p", "2026-06-06", 3), ("p", "2026-05-01", 4)], "parish string, d string, doc int").selectExpr("parish", "date(d) AS day", "doc")
    got = {str(r["day"]): r["previous_doc"] for r in lookups.previous_edition(ed, ["parish"], "day", "doc").collect()}
    assert got == {"2026-06-14": 3, "2026-06-08": None, "2026-06-06": None, "2026-05-01": None}
    assert lookups.count_of_keys(rows.selectExpr("'g' AS g", "n AS k"), spark.createDataFrame([("g", "new one"), ("h", "x")], "g string, k string"), ["g"], "k").orderBy("g").collect() == [("g", 1), ("h", 0)]


LINKS = [("p", 0, "https://x/070626.pdf", "old"), ("p", 1, "https://x/140626.pdf", "this week"), ("p", 2, "https://x/notes.pdf", "undated"), ("p", 3, "mailto:a@b", "mail"), ("q", 0, "https://x/010126.pdf", "old"), ("q", 1, "https://x/donation-5-1-26.pdf", "older"), ("r", 0, "https://x/news.pdf", "")]


def test_ranking(spark):
    links = spark.createDataFrame(LINKS, "page string, idx int, href string, text string")
    t = F.lit("2026-06-14").cast("date")
    best = lambda df: {r["page"]: r["idx"] for r in df.collect()}
    assert best(ranking.best_candidate(links, t)) == {"p": 1, "q": 1, "r": 0}
    assert best(ranking.best_listing_link(links, t)) == {"p": 1, "q": 1, "r": 0}
    assert best(ranking.best_listing_link(links.where("idx = 0 AND page = 'q'"), t)) == {}
    assert best(ranking.best_document(links)) == {"p": 1, "q": 0, "r": 0}
    assert best(ranking.date_first(links)) == {"p": 1, "q": 0, "r": 0}
    assert {r["page"] for r in ranking.stale_pages(links.where("idx = 0 AND page <> 'r'"), t).collect()} == {"p", "q"}
    assert best(ranking.ranked_links(links, spark.createDataFrame([("p", "undated")], "page string, text string")).where("rank = 1"))["p"] == 2
    assert {r["page"] for r in ranking.ambiguous_pages(spark.createDataFrame([("a", 0, "x", ""), ("a", 1, "y", ""), ("b", 0, "x/2026-06-14", ""), ("b", 1, "y", "")], "page string, idx int, href string, text string")).collect()} == {"a"}
    pages = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "none")], "page int, html string")
    got = {(r["page"], r["rule"], r["score"]) for r in ranking.fingerprints(pages, (RuleSet("one", "k", 10, (("alpha", 5), ("beta", 6))), RuleSet("two", "k", 3, (("beta", 10),)))).collect()}
    assert got == {(1, "one", 11), (1, "two", 10), (2, "two", 10)}


EVIDENCE = """﻿# -- Antrim --
# Pattern A: six digits
- https://www.antrim.ie/pdf/050426.pdf
https://www.antrim.ie/pdf/120426.pdf

# ——— Aghagallon and Ballinderry ———
# key: agha
# page: https://agha.ie/news
# html_link only
• https://agha.ie/latest
# --- Empty ---
# Pattern D
# --- Docs ---
* https://docs.ie/5-4-26.docx?x
"""


def test_sections(spark):
    lines = sections.numbered_lines(spark.createDataFrame([("f", EVIDENCE)], "file string, value string"))
    got = [(r["key"], r["display_name"], r["pattern"], r["content_type"], r["bulletin_page"], len(r["all_urls"])) for r in sections.source_entries(lines).orderBy("section").collect()]
    assert got == [("antrim", "Antrim", "A", "pdf", "", 2), ("agha", "Aghagallon and Ballinderry", "html_link", "html_link", "https://agha.ie/news", 1), ("docs", "Docs", "B", "docx", "", 1)]
    assert [(r["name"], r["url"]) for r in sections.name_links(lines).orderBy("section").collect()][0] == ("Antrim", "https://www.antrim.ie/pdf/050426.pdf")
    docs = spark.createDataFrame([(1, "intro\n Banagher \ntext one\nCuldaff\ntext two\nBanagher\nmore"), (2, None), (3, "nothing")], "doc_id long, text string")
    names = spark.createDataFrame([("b", "Banagher Parish"), ("c", "Culdaff (old)"), ("d", "Missing")], "key string, display_name string")
    assert {(r["key"], r["chunk"]) for r in sections.split_by_markers(docs, names).collect()} == {("b", "Banagher \ntext one"), ("c", "Culdaff\ntext two\nBanagher\nmore")}
    clicks = spark.createDataFrame([("c", 1, "u"), ("c", 2, "u"), ("c", 3, "v"), ("c", 4, None)], "chain string, seq int, url string")
    assert [r["action"] for r in sections.with_gotos(clicks).orderBy("step").collect()] == ["goto", "click", "click", "goto", "click", "click"]


def test_keys(spark):
    assert spark.createDataFrame([(" A b ",)], "k string").select(norm_key("k")).first()[0] == "a b"


def test_recipes(spark):
    rows = [
        ("a", "https://x/5th-april-2026", "active", [("click", "https://drive.google.com/drive/folders/1", None, "26.06.07.pdf"), ("download", "https://x/a", None, None), ("html", "https://x/b", None, None)]),
        ("b", "https://y", " Inactive ", None), ("c", "https://z", None, [("goto", "https://z", None, None), ("", None, None, None)]),
    ]
    df = spark.createDataFrame(rows, f"key string, start_url string, status string, steps array<{recipes.STEP}>")
    f = {r["key"]: r for r in recipes.fingerprints(df).collect()}
    assert (f["a"]["flow"], f["a"]["clicks"], f["a"]["cloud"], f["b"]["n_steps"]) == ("click>download>html", 1, True, 0)
    t = F.lit("2026-06-14").cast("date")
    s = {r["key"]: r for r in recipes.redated(recipes.standalone(df), t).collect()}
    assert [x["action"] for x in s["a"]["steps"]] == ["goto", "click", "html"] and s["a"]["steps"][1]["text"] == "26.06.14.pdf" and s["a"]["use_target_url"] and s["a"]["cloud_folder"]
    assert [x["action"] for x in s["b"]["steps"]] == ["goto"] and [x["action"] for x in s["c"]["steps"]] == ["goto"]
    health = spark.createDataFrame([("a", 2, "nxdomain"), ("b", 3, "nxdomain"), ("c", 2, "error")], "key string, strikes int, last_result string")
    assert [r["key"] for r in recipes.dead_sources(df, health).collect()] == ["a"]
    entries = spark.createDataFrame([("a", 1, "u1"), ("n", 3, "u3"), ("n", 2, "u2")], "key string, seq int, url string")
    assert [tuple(r) for r in recipes.seeds(entries, df).collect()] == [("n", "u2")]
    reg = spark.createDataFrame([("k1", "https://www.one.ie/"), ("k2", "https://shared.ie/a"), ("k3", "https://shared.ie/b/")], "key string, url string")
    urls = spark.createDataFrame([("https://one.ie/news",), ("https://shared.ie/b",), ("https://other.ie",), (None,)], "url string")
    assert {r["url"]: r["source"] for r in recipes.registry_keys(urls, reg, ["shared.ie"]).collect()} == {"https://one.ie/news": "k1", "https://shared.ie/b": "k3", "https://other.ie": "other", None: None}
    over = df.withColumn("override_url", F.when(F.col("key") == "b", " https://o "))
    assert [r[0] for r in over.orderBy("key").select(recipes.effective_start()).collect()] == ["https://x/b", "https://o", "https://z"]


def test_edits_images_and_weeks(spark):
    lines = sections.sectioned(sections.numbered_lines(spark.createDataFrame([("f", "# --- A ---\nhttps://old\nhttps://older\n# --- B ---\n# note")], "file string, value string")))
    edits = spark.createDataFrame([("f", "A", "https://new"), ("f", "B", "https://b")], "file string, name string, url string")
    assert [r["line"] for r in recipes.edited_sections(lines, edits).orderBy("pos").collect()] == ["# --- A ---", "https://new", "https://older", "# --- B ---", "https://b", "# note"]
    img = spark.createDataFrame([("p", 0, "a.png", "", 900, 700, False), ("p", 1, "b.png", "newsletter", 900, 700, True), ("p", 2, "c.svg", "", 900, 700, True), ("p", 3, "d.png", "", 100, 900, True)], "page string, idx int, src string, alt string, width int, height int, in_main boolean")
    assert [r["idx"] for r in ranking.best_images(img).orderBy(F.desc("score")).collect()] == [1, 0]
    links = spark.createDataFrame([("p", 0, "x/2026-01-01", ""), ("p", 1, "x/2026-06-13", ""), ("q", 0, "x/2026-01-01", ""), ("r", 0, "x", "")], "page string, idx int, href string, text string")
    assert {r["page"]: r["idx"] for r in ranking.this_week(links, F.lit("2026-06-14").cast("date")).collect()} == {"p": 1, "q": 0}
    rows = spark.createDataFrame([("a", 1, "2026-01-01 00:00:00"), ("a", 2, "2026-01-02 00:00:00"), ("b", 3, "2025-01-01 00:00:00")], "k string, seq int, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert {r["k"]: r["seq"] for r in ranking.first_after(rows, ["k"], "ts", F.lit("2026-01-02 00:00:05").cast("timestamp"), "seq").collect()} == {"a": 2, "b": 3}
    res = spark.createDataFrame([("a", "ok", None, None, "B", 2), ("b", "ok", True, None, "A", 1), ("c", "ok", None, None, "C", 9), ("d", "ok", None, None, "D", 1)], "key string, status string, is_fallback boolean, is_stale boolean, display_name string, n_pages int")
    assert [r["key"] for r in recipes.stitch_plan(res, spark.createDataFrame([("d",)], "key string")).collect()] == ["a"]


ARTICLE = '<html><title>Parish newsletter</title><article class="post entry-content">' + "<p>Words of this week for all who read them here.</p>" * 20 + "</article> wp-content/themes"
PAGES = [
    ("https://x/a.pdf?1", "", "direct_pdf"), ("", "<a href='n.pdf'>x</a>", "pdf_links"), ("", "<div><a href='/y'>" + "word " * 200, "html"), ("", "<div>" + "word " * 200, "unknown"), ("", None, "unknown"),
    ("https://drive.google.com/drive/folders/1", "", "cloud_folder"), ("", "see https://drive.google.com/drive/folders/1 of 26.06.14 <a href='x'>", "html"), ("", ARTICLE, "wix_html"),
    ("", '<script src="//www.theparishmessenger.com/x.js"></script>', "parish_messenger"), ("", '<a class="pdfemb-viewer" href="x.pdf">', "pdfemb"), ("", '<a class="pdfemb-viewer" href="x.pdf"> wp-content/plugins/pdf-embedder', "pdfemb"),
    ("", "<iframe src='https://wixlabs-pdf-dev.appspot.com/?url=x'>", "wix_viewer"), ("", '<iframe src="/onewebmedia/Newsletter 1-2-26.docx"> onewebstatic', "oneweb_docx"), ("", '<iframe src="/x/a.pdf">', "iframe"), ("", '<iframe src="https://dropbox.com/z">', "iframe_maybe"),
    ("", '<object data="n.pdf">', "embed"), ("", '<a href="/safeguarding.pdf">s</a> <b>weekly bulletins</b> Sunday 4', "weekly_bulletin_download"), ("", "com_dropfiles mod_dropfiles_latest mod_downloadlink", "weekly_bulletin_download"),
    ("https://x/june_2026", "static.wixstatic.com <b>", "wix_html"), ("https://x/", "static.wixstatic.com " + '<a href="/may_2026">' * 4, "wix_date_grid"),
    ("", '<article><img src="/wp-content/uploads/bulletin.jpg" width="900"></article> wordpress', "image"), ("", '<article><img src="/wp-content/uploads/logo.jpg" width="900"></article>', "unknown"),
]


def test_kinds_of_pages(spark):
    rows = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(PAGES)], "i int, u string, h string").select("i", page_type(F.col("u"), F.col("h")).alias("k")).collect()
    assert {r["i"]: r["k"] for r in rows} == {i: k for i, (_, _, k) in enumerate(PAGES)}


def test_rules_with_tests_of_the_content(spark):
    sets = (RuleSet("must", "k", 5, (("alpha", 10),), "text", True), RuleSet("part", "k", 3, (("alpha", 10),), "text"), RuleSet("high", "k", 4, (("alpha", 10),), "image"))
    df = spark.createDataFrame([(1, "alpha"), (2, "alpha" + ARTICLE), (3, None)], "page int, html string")
    got = {(r["page"], r["rule"], r["score"]) for r in ranking.fingerprints(df, sets).collect()}
    assert got == {(1, "part", 3), (2, "must", 10), (2, "part", 10)}


def test_links_of_equal_date_keep_page_order_and_rejected_ones_are_no_alternatives(spark):
    links = spark.createDataFrame([("p", 0, "x/2026-06-14-bulletin", "a"), ("p", 1, "x/2026-06-14-bulletin", "b"), ("p", 2, "x/giftaid-2026-06-21", "Gift Aid"), ("p", 3, "x/old", "c"), ("q", 0, "x/privacy", "Privacy"), ("q", 1, "x/gdpr", "GDPR")], "page string, idx int, href string, text string")
    got = {(r["page"], r["rank"]): r["idx"] for r in ranking.ranked_links(links).collect()}
    assert got == {("p", 1): 0, ("p", 2): 1, ("p", 3): 3, ("q", 1): 1}


def test_best_weekly(spark):
    rows = [("p", 0, "x/weekly-bulletins/5/", "14 June 2026", False), ("p", 1, "x/weekly-bulletins/6/", "21 June 2026", False), ("p", 2, "x/other", "28 June 2026", True), ("q", 0, "x/weekly-bulletins/1/", "", True), ("q", 9, "x/weekly-bulletins/2/", "", False), ("r", 0, "x/y", "", True)]
    got = {r["page"]: r["idx"] for r in ranking.best_weekly(spark.createDataFrame(rows, "page string, idx int, href string, text string, is_download boolean")).collect()}
    assert got == {"p": 1, "q": 0}


def test_steps(spark):
    t = F.lit("2026-06-14").cast("date")
    step = "struct<action:string,url:string,selector:string,text:string,fallback_selectors:array<string>>"
    df = spark.createDataFrame([("a", [("click", None, None, "26.06.07.pdf", ["  own ", "", ':has-text("26.06.14")']), ("click", None, "x", "plain", None), ("goto", "26.01.01", None, None, None)])], f"key string, steps array<{step}>")
    s = recipes.cloud_steps(df, t).first()["steps"]
    assert s[0]["text"] == "26.06.14.pdf" and s[0]["selector"] == ':has-text("26.06.14")' and s[0]["fallback_selectors"][-1] == "own" and len(s[0]["fallback_selectors"]) == 6
    assert s[1]["text"] == "plain" and s[2]["url"] == "26.01.01"
    clicks = spark.createDataFrame([("A", "link", "Bulletin 14 June", "x.pdf", "div > a"), ("div", None, "12", "y.docx", None), (None, None, "7", None, "p"), (None, None, "3", "", " ")], "tag string, role string, text string, href string, css_path string")
    got = [(r["selector"], r["fallback_selectors"]) for r in recipes.click_steps(clicks).collect()]
    assert got[0] == ("a:has-text('Bulletin')", ['role=link[name="Bulletin"]', "a[href$='.pdf']", "a[href*='.pdf']", "div > a"])
    assert got[1] == ("a[href$='.docx']", ["a[href*='.pdf']"]) and got[2][0] == "p" and len(got) == 3
    known = spark.createDataFrame([("list", "pb", "st", True, ["n"], True)], "page_type string, playbook string, site_type string, auto_direct boolean, operator_notes array<string>, skip_goto boolean")
    r = spark.createDataFrame([("a", "list", [("goto", None, None, None), ("download", None, None, None)]), ("b", "list", [("goto", None, None, None)]), ("c", None, [])], f"key string, page_type string, steps array<{recipes.STEP}>")
    e = {x["key"]: x for x in recipes.enriched(r, known).collect()}
    assert len(e["a"]["steps"]) == 1 and len(e["b"]["steps"]) == 1 and e["b"]["playbook"] == "pb" and e["c"]["playbook"] is None
    h = spark.createDataFrame([("list", None, ["A", "B"], "u"), ("zz", "tip", [], " ")], "t string, tip string, names array<string>, u string").select(recipes.hint(F.col("t"), {"list": "a list", "unknown": "?"}, F.col("tip"), F.col("names"), F.col("u")).alias("h")).collect()
    assert [x["h"].split("\n") for x in h] == [["This looks like: a list", "Similar sources already solved: A, B", "This week's address may be: u"], ["This looks like: ?", "Learned tip: tip"]]


def test_sections_are_disabled_and_cut_out(spark):
    text = "# --- One ---\nhttps://a.ie/x\n\n# --- Two ---\n# DISABLED before\n# page: https://b.ie/\n\n# --- Three ---"
    lines = sections.sectioned(sections.numbered_lines(spark.createDataFrame([("f", text)], "file string, value string")))
    d = {r["name"]: r for r in sections.declared_sections(sections.numbered_lines(spark.createDataFrame([("f", text)], "file string, value string"))).collect()}
    assert (d["One"]["urls"], d["One"]["disabled"], d["Two"]["urls"], d["Two"]["disabled"], d["Three"]["key"]) == (["https://a.ie/x"], False, [], True, "")
    names = spark.createDataFrame([("f", "one"), ("f", "Two"), ("f", "none")], "file string, name string")
    out = [r["line"] for r in sections.disabled_sections(lines, names).orderBy("pos").collect()]
    assert out[:3] == ["# --- One ---", "# DISABLED", "https://a.ie/x"] and len(out) == 9
    blocks = {r["name"]: r["block"] for r in sections.section_block(lines).collect()}
    assert blocks["One"] == "# --- One ---\nhttps://a.ie/x" and blocks["Three"] == "# --- Three ---"


def test_segments_do_not_change_the_fold(spark):
    rng = random.Random(8)
    rows = [(rng.choice("abc"), i, rng.choice(["ok", "bad", "bad", "x"])) for i in range(300)] + [("d", 1000, "bad")]
    df = spark.createDataFrame(rows, "key string, seq long, r string")
    fold = lambda n: sorted(map(tuple, state._since(df, "key", "seq", F.col("r") == "ok", F.col("r") == "bad", n).collect()))
    want = []
    for k in "abcd":
        own = [(q, r) for x, q, r in rows if x == k]
        last = max((q for q, r in own if r == "ok"), default=None)
        want.append((k, last, sum(r == "bad" and (last is None or q > last) for q, r in own)))
    assert fold(1 << 16) == fold(7) == fold(1) == want


def test_run_of_equal_values_over_segments(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k, i, rng.choice(["u", "v", None]) if i < 60 else k) for i in range(80) for k in "uvw"] + [("n", 5, None), ("n", 6, None)]
    df = spark.createDataFrame(rows, "key string, seq long, new_url string")
    want = {}
    for k in {r[0] for r in rows}:
        vals = [v for x, _, v in sorted(rows, key=lambda r: r[1]) if x == k]
        want[k] = (vals[-1], next((n for n, v in enumerate(reversed(vals)) if v != vals[-1]), len(vals)))
    for n in (1 << 16, 7, 1):
        monkeypatch.setattr(state, "SEGMENT", n)
        assert {r["key"]: (r["new_url"], r["confidence"]) for r in state.confidence(df).collect()} == want


def test_named_sundays(spark):
    rows = calendar.named_sundays(spark.createDataFrame([(2026,), (2025,), (2023,), (2026,), (None,)], "year int")).collect()
    got = {str(r["day"]): r["name"] for r in rows}
    assert len(got) == len(rows)
    want = {
        "2026-01-04": "Epiphany_of_the_Lord", "2026-01-11": "Baptism_of_the_Lord", "2026-01-18": "2nd_Sunday_in_Ordinary_Time", "2026-02-15": "Sixth_Sunday_in_Ordinary_Time", "2026-02-22": "1st_Sunday_of_Lent",
        "2026-04-05": "Easter_Sunday_2026", "2026-05-24": "Pentecost_Sunday", "2026-06-14": "11th_Sunday_in_Ordinary_Time", "2026-11-01": "All_Saints_Day", "2026-11-15": "33rd_Sunday_in_Ordinary_Time",
        "2026-11-22": "Our_Lord_Jesus_Christ_King_of_the_Universe", "2026-11-29": "1st_Sunday_of_Advent", "2026-12-25": "Christmas_Day", "2026-12-27": "The_Holy_Family", "2023-12-31": "The_Holy_Family", "2025-12-28": "The_Holy_Family",
    }
    assert {k: got.get(k) for k in want} == want
    import datetime as dt

    days = {dt.date(2026, 1, 4) + dt.timedelta(days=7 * i) for i in range(52)}
    assert {str(d) for d in days} <= set(got)


def test_freshness_gate(spark):
    rows = [("a", "ok", None, "https://x/010126.pdf", "pdf"), ("b", "ok", None, "https://x/140626.pdf", "pdf"), ("c", "ok", None, "https://x/undated", "pdf"), ("d", "error", None, "https://x/010126.pdf", "pdf"), ("e", "ok", True, "https://x/010126.pdf", "pdf"), (None, "ok", None, None, None), ("f", "ok", None, "https://x/2026-08-01", "recipe")]
    df = spark.createDataFrame(rows, "key string, status string, is_stale boolean, url string, file_type string").selectExpr("*", "key AS display_name", "string(null) AS error", "string(null) AS stale_reason", "string(null) AS retry_strategy")
    entries = spark.createDataFrame([("a", "A", "pdf", "https://page")], "key string, pattern string, content_type string, bulletin_page string")
    out, retry = reports.freshness_gate(df, F.lit("2026-06-14").cast("date"), entries)
    assert out.columns == df.columns and out.count() == 7
    assert {(r["key"], r["reason"], r["strategy"], r["bulletin_page"]) for r in retry.collect()} == {("a", "date_behind_of_target", "rescrape_bulletin_page", "https://page"), ("f", "date_ahead_of_target", "retrain_recipe", "")}
    assert {r["key"] for r in out.where("status = 'error'").collect()} == {"a", "d", "f"}
