"""Pairs of input and expected value for the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac.functions import arrays as A
from almanac.functions import dates as D
from almanac.functions import predicates as P
from almanac.functions import pyudf as Y
from almanac.functions import text as X
from almanac.functions import urls as U


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def day(s):
    return dt.date.fromisoformat(s) if s else None


DATES = [
    ("x/2026-06-14.pdf", "2026-06-14"), ("20260426", "2026-04-26"), ("26042026", "2026-04-26"), ("bulletin_150626.pdf", "2026-06-15"), ("26.06.14", "2026-06-14"), ("14-6-26", None),
    ("2026-02-31", None), ("1234567", None), ("310226", None), ("", None), ("99999999 010226", "2026-02-01"),
]


def test_dates_in_text(spark):
    assert apply(spark, [a for a, _ in DATES], D.date_in_text) == [day(b) for _, b in DATES]


def test_slug_dates(spark):
    pairs = [("26th-April-2026", "2026-04-26"), ("3-may-2026", "2026-05-03"), ("5_april_2026", "2026-04-05"), ("5_foo_2026", None), ("31-june-2026", None), ("1st-sept-2025", "2025-09-01")]
    assert apply(spark, [a for a, _ in pairs], D.date_in_slug) == [day(b) for _, b in pairs]


def test_other_date_readings(spark):
    assert apply(spark, ["a/7/6/2026/x", "14_06_2026", "no"], D.bulletin_date) == [day("2026-06-07"), day("2026-06-14"), None]
    assert apply(spark, ["2026/6/7", "010299", "31022026 07062026"], D.url_date) == [day("2026-06-07"), day("1999-02-01"), day("2026-06-07")]
    got = apply(spark, ["/2026/04/26/x", "24th may 2026", "May 2026", "/2026/04/", "in 2025", "pdf/240526.pdf", "none"], lambda c: D.date_score(D.partial_date(c)))
    assert got == [20260426, 20260524, 20260500, 20260400, 20250000, 20260524, 0]


def test_sundays_and_freshness(spark):
    days = [day("2026-06-14"), day("2026-06-15"), day("2026-06-20")]
    assert apply(spark, days, D.target_sunday, "date") == [day("2026-06-14")] * 3
    assert apply(spark, days, D.next_sunday, "date") == [day("2026-06-21")] * 3
    assert apply(spark, days, D.coming_sunday, "date") == [day("2026-06-14"), day("2026-06-21"), day("2026-06-21")]
    t = F.lit("2026-06-14").cast("date")
    dates = [day(x) for x in ("2026-06-14", "2026-06-08", "2026-06-07", "2026-06-22", "2026-06-23", "2026-06-05", None)]
    got = [(r["status"], r["reason"]) for r in apply(spark, dates, lambda c: D.freshness(c, t), "date")]
    assert got == [("fresh", "in_bulletin_week")] * 2 + [("fresh", "within_grace_days")] * 2 + [("stale", "date_ahead_of_target"), ("stale", "date_behind_of_target"), ("unknown", "no_date_in_url")]


def test_easter_and_formats(spark):
    assert apply(spark, [2024, 2025, 2026, 2038], D.easter, "int") == [day(x) for x in ("2024-03-31", "2025-04-20", "2026-04-05", "2038-04-25")]
    assert apply(spark, [1, 2, 3, 4, 11, 12, 13, 21, 111], D.ordinal, "int") == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "111th"]
    assert apply(spark, ["2026-99-99", "x"], D.day_month_year) == ["99-99-2026", "x"] and apply(spark, ["2026-99-99"], D.day_month_year_checked) == ["2026-99-99"]
    assert apply(spark, [1, 60, 61, 125], D.duration, "int") == ["1 second", "1 minute", "1 minute 1 second", "2 minutes 5 seconds"]
    assert apply(spark, [day("2026-06-14")], D.long_date, "date") == ["14 June 2026"] and apply(spark, [day("2026-06-04")], D.dotted, "date") == ["26.06.04"]


@pytest.mark.parametrize(
    ("url", "target", "want"),
    [
        ("https://x.org/wp/2026/03/29-March-2026.pdf", "2026-04-05", "https://x.org/wp/2026/04/5-April-2026.pdf"),
        ("https://x.org/e-7_june_2026", "2027-06-13", "https://x.org/e-13_june_2027"),
        ("https://x.org/pdf/050426.pdf", "2026-04-12", "https://x.org/pdf/120426.pdf"),
        ("https://x.org/2026/04/2026-04-05.pdf", "2026-05-03", "https://x.org/2026/05/2026-05-03.pdf"),
        ("https://x.org/m/5-4-26.pdf", "2026-04-12", "https://x.org/m/12-4-26.pdf"),
        ("https://x.org/[2026-4-5].pdf", "2026-04-12", "https://x.org/[2026-4-12].pdf"),
        ("https://x.org/2026/04/03/news-a/", "2026-04-12", "https://x.org/2026/04/10/"),
        ("https://x.org/2026/04/1.jpg", "2026-05-03", "https://x.org/2026/05/1.jpg"),
        ("https://x.org/fixed.pdf", "2026-05-03", "https://x.org/fixed.pdf"),
    ],
)
def test_moved_urls(url, target, want):
    assert Y.moved_url(url, day(target)) == want


def test_url_spellings(spark):
    got = Y.other_spellings("https://x.org/050426.pdf", day("2026-04-12"))
    assert got[0] == "https://x.org/120426.pdf" and len(got) == 6
    assert Y.other_spellings("https://x.org/050420.pdf", day("2026-04-12")) == []
    t = F.lit("2026-04-12").cast("date")
    assert apply(spark, ["https://x/5th-April-2026.pdf", "https://x/none"], lambda c: U.slug_url(c, t)) == ["https://x/12-april-2026.pdf", "https://x/none"]
    assert apply(spark, ["https://x/2025/12/29-March-2026.pdf", "https://x/2020/12/a"], lambda c: U.upload_url(c, t)) == ["https://x/2026/04/12-april-2026.pdf", "https://x/2020/12/a"]
    assert apply(spark, ["https://x/Newsletters/384/Divine---5th-April-2026", "https://x/Weekly-Bulletins/95/a", "https://x/y"], lambda c: U.next_newsletter(c, t)) == [
        "https://x/Newsletters/385/", "https://x/Weekly-Bulletins/96/", "https://x/y"]


def test_url_parts(spark):
    urls = ["https://www2.Kilmore.example/a b/C/", "https://i0.wp.com/www.kilmore.ie/x.pdf", "https://drive.google.com/file/d/AB/view", "nonsense", None]
    assert apply(spark, urls, lambda c: U.url_key(c, F.lit("St Ann (old)"))) == ["kilmore", "kilmore", "stann", None, None]
    assert apply(spark, urls[:1], U.normal_url) == ["kilmore.example/a%20b/c"]
    assert apply(spark, ["https://docs.google.com/viewer?url=https%3A%2F%2Fx.org%2Fa.pdf", "https://x.org/?url=b"], U.unwrapped) == ["https://x.org/a.pdf", "https://x.org/?url=b"]
    assert apply(spark, urls[2:3], U.direct_download) == ["https://drive.usercontent.google.com/download?id=AB&export=download"]
    assert apply(spark, ["https://x/a+b%20c%zz", "https://x/a+b%20c"], U.decoded) == ["https://x/a+b%20c%zz", "https://x/a+b c"]
    m = lambda p: (lambda c: U.matches_pattern(c, F.lit(p)))
    assert apply(spark, ["https://x/A.PDF?x=1", "https://x/a.doc"], m("*.pdf")) == [True, False] and apply(spark, ["https://x/news-1.pdf"], m("*news-?.pdf")) == [True]
    got = apply(spark, ["https://x.org/a/b/c.pdf"], lambda c: U.seed_urls(c, F.lit("https://y.org/z"), F.lit(False)))[0]
    assert got == ["https://x.org/a/b/c.pdf", "https://y.org/z", "https://x.org/", "https://x.org/a/b/", "https://y.org/"]


def test_predicates(spark):
    assert apply(spark, ["x/GiftAid.pdf", "x/giftaid-bulletin.pdf", "x/news.pdf", None], P.other_document) == [True, False, False, False]
    assert apply(spark, ["https://x/a.pdf?q", "https://drive.google.com/x", "https://x/a.html", "https://x/a.DOCX"], P.document_link) == [True, True, False, True]
    assert apply(spark, ["https://drive.google.com/drive/folders/1", "https://1drv.ms/x", "https://x"], P.cloud_folder) == [True, True, False]
    assert apply(spark, ["getaddrinfo failed", "SSL error", "Timeout 5", "html_link only", "boo", None], P.error_kind) == ["dns", "ssl", "timeout", "no_pdf", "other", "other"]
    assert apply(spark, ["abc", "140626", "26.06.14-pdf", "x12345-pdf", "kilmore"], P.junk_key) == [True, True, True, True, False]
    assert apply(spark, ["http://x/a.jpg", "ftp://x", "http://x/a.pdf"], lambda c: P.override_type(c, F.lit("??"))) == ["image", None, "download"]
    assert apply(spark, [0.8, 0.5, 0.49], lambda c: P.tier(c, F.lit(0)), "double") == ["green", "amber", "red"]
    assert apply(spark, [0, 2, 3, None], lambda c: P.tier(F.lit(None).cast("double"), c), "int") == ["green", "amber", "red", "grey"]
    assert apply(spark, [84.9, 85.0, 60.0, 0.0], P.traffic_light, "double") == ["amber", "red", "amber", "green"]
    assert apply(spark, ["Sunday 09:30", "Sun 9", "Monday 25:00"], P.schedule_ok) == [True, False, False]
    assert apply(spark, ["HTTP 403", "fine", None], P.bot_block) == [True, False, False]
    assert apply(spark, [b"%PDF" + b"x" * 20_000, b"%PDF", b"html" * 9000], P.pdf_bytes, "binary") == [True, False, False]


def test_text(spark):
    assert apply(spark, ["Kilmóre & St Ann (Old (x))"], X.name_forms) == [["kilmore and st ann old x", "kilmore and saint ann old x", "kilmore and st ann", "kilmore and saint ann"]]
    assert apply(spark, ["Éire  Ñ!"], X.slug) == ["eire-n"] and apply(spark, [None, "A b-1"], X.norm_key) == ["", "ab1"]
    assert apply(spark, ["Short\nA line that  is Long enough\r\nanother line long enough"], X.compared_lines) == [["a line that is long enough", "another line long enough"]]
    assert apply(spark, ["<p>a  b</p><br>\n<i>c</i>"], X.html_text) == ["a b\nc"]
    assert apply(spark, ["<b>Ann</b><b>ann!</b><b>Bo</b>"], lambda c: X.found_names(c, "<b>([^<]*)</b>")) == [["Ann", "Bo"]]
    assert apply(spark, ["see https://x.org/a). or www.y.ie/b, a@b.ie"], X.links) == [["https://x.org/a", "www.y.ie/b"]] and apply(spark, ["a@b.ie a@b.ie"], X.mails) == [["a@b.ie"]]
    assert apply(spark, ["x" * 100 + "HIT" + "y" * 100, "z" * 200], lambda c: X.snippet(c, F.lit("hit"))) == ["x" * 75 + "HIT" + "y" * 75, "z" * 150]
    assert apply(spark, ["| a |", "---", "# h", " ", "p"], X.line_kind) == ["table", "rule", "heading", "blank", "paragraph"]
    assert apply(spark, ["12th April Notes", "Sunday newsletter", "1 2"], X.undated_word) == ["Notes", "Newsletter", ""]
    assert apply(spark, ["a\\b;c,d\ne\r"], X.ics_escape) == ["a\\\\b\\;c\\,d\\ne"] and apply(spark, ['<a & "b">'], X.xml_escape) == ["&lt;a &amp; &quot;b&quot;&gt;"]
    assert [tuple(r) for r in apply(spark, ["this week newsletter.pdf", "gift aid", "x"], lambda c: X.phrase_points(F.lit(""), c))] == [(88, 0), (0, 120), (0, 0)]
    assert apply(spark, ["&amp;amp;lt;", None], Y.unescape4) == ["<", None] and apply(spark, ["ÉCŁAIR ﬁ"], Y.fold_marks) == ["ecłair fi"]


def test_arrays(spark):
    raw = ['```json\n[{"title":"Mass","date_iso":"2026-6-1","category":"MASS","time_24h_or_null":""},{"title":"","date_iso":"2026-06-01"},{"title":"x","date_iso":"2026-02-30"},{"title":"y","date_iso":"2026-06-02","category":"odd"}]\n```', "[]", "no json", "[broken"]
    got = apply(spark, raw, A.events_of)
    assert [[(e["title"], e["category"], e["time_24h_or_null"]) for e in g] for g in got] == [[("Mass", "mass", None), ("y", "other", None)], [], [], []]
    assert apply(spark, ["- a\n\n* b\n• c", "a\nb"], A.bullets) == [["a", "b", "c"], None]
    assert apply(spark, ["Bingo and a Table Quiz"], A.keyword_hits) == [["bingo", "table quiz"]]
    assert apply(spark, ["500", None, "x", "999999", "20000"], lambda c: A.step_timeout(F.lit(None).cast("string"), c), "string") == [1000, 15000, 15000, 120000, 20000]
    assert apply(spark, [["goto", "download", "click", "image"], ["click"]], A.last_terminal_only, "array<string>") == [["goto", "click", "image"], ["click"]]
    assert apply(spark, ["5", "-1", "x"], A.clamped_int) == [5, 0, 0] and apply(spark, ["5", "-1", "x"], lambda c: A.clamped_int(c, True)) == [5, -1, None]
    assert apply(spark, [{"a": 1}], lambda c: A.overlay_defaults(F.create_map(F.lit("a"), F.lit(9), F.lit("b"), F.lit(2)), c), "map<string,int>") == [{"a": 1, "b": 2}]
    assert apply(spark, [["a"], None], lambda c: A.capped_union(c, F.lit("b")), "array<string>") == [["a", "b"], ["b"]]


def test_line_diff():
    old = "The first line is kept here\nThe second line goes away now\n-- dashes are lost in a diff"
    new = "The first line is kept here\nA third line comes in instead"
    d = Y.line_diff(new, old)
    assert d == {"added": ["a third line comes in instead"], "removed": ["the second line goes away now"], "kept": 1, "note": None}
    many = "\n".join(f"an added line number {i:02d} " + "x" * i for i in range(45))
    d = Y.line_diff(many, None)
    assert len(d["added"]) == 30 and d["note"] == "truncated_to_30_lines_per_side" and len(d["added"][0]) == max(map(len, d["added"]))


def test_html_links(spark):
    html = '<a href="/a.pdf">A  <b>x</b></a><iframe src="https://y/v"></iframe><a>no</a><embed src="e.pdf">'
    got = spark.createDataFrame([(html, "https://x.org/p/"), (None, None)], "h string, u string").select(Y.html_links("h", "u")).collect()
    assert [(r["idx"], r["href"], r["text"]) for r in got[0][0]] == [(0, "https://x.org/a.pdf", "A x"), (1, "https://y/v", ""), (2, "https://x.org/p/e.pdf", "")] and got[1][0] == []


def test_text_as_html(spark):
    def html(f, *texts):
        return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(f(F.col("t"))).collect()]

    got = html(X.linkified, "Mail a.b@c.ie & see www.x.ie/a_(b), (https://y.ie/z). 074 912 3456 or +353 87-123-4567!", "028 7131 23456 <b> o'x", None, "https://x.ie/0749123456")
    assert got[0] == (
        'Mail <a href="mailto:a.b@c.ie">a.b@c.ie</a> &amp; see <a href="https://www.x.ie/a_(b)">www.x.ie/a_(b)</a>, (<a href="https://y.ie/z">https://y.ie/z</a>). '
        '<a href="tel:+353749123456">074 912 3456</a> or <a href="tel:+353871234567">+353 87-123-4567</a>!'
    )
    assert got[1] == "028 7131 23456 &lt;b&gt; o&#x27;x" and got[2] is None and got[3] == '<a href="https://x.ie/0749123456">https://x.ie/0749123456</a>'
    r = html(X.rendered, "# Title\n\n| a | **b** |\n| c | d |\ntext *so* __x__\n---\n##### deep\n| e | f |")[0].split("\n")
    assert r == ["<h1>Title</h1>", "<table><tr><td>a</td><td><strong>b</strong></td></tr><tr><td>c</td><td>d</td></tr></table>", "<p>text <em>so</em> <strong>x</strong></p>", "<hr>", "<h4>deep</h4>", "<table><tr><td>e</td><td>f</td></tr></table>"]


def test_addresses_by_pattern(spark):
    t = F.lit("2026-06-14").cast("date")
    rows = [("F", "https://x.ie/a-2025-06-15.pdf"), ("html_link", "https://x.ie/"), ("A", "https://x.ie/070626.pdf"), ("H", "https://x.ie/files/Newsletters/7/7-June-2026"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, u string").select(Y.calculated_url(F.col("p"), F.col("u"), t)).collect()]
    assert got[:3] == ["https://x.ie/a-2025-06-15.pdf", "https://x.ie/", "https://x.ie/140626.pdf"] and "/8/" in got[3] and got[4] is None
    docs = spark.createDataFrame([("https://c.com/onewebmedia/newsletter%207-6-26%20-.docx",), ("https://c.com/n/070626.docx",), ("https://c.com/070626.pdf",), (None,)], "u string")
    got = [r[0] for r in docs.select(Y.docx_variants("u", t)).collect()]
    assert got[0][1:] == ["https://c.com/onewebmedia/newsletter%2014-6-26.docx", "https://c.com/onewebmedia/newsletter%2014-6-26%20.docx", "https://c.com/onewebmedia/newsletter%2014-6-26%20-.docx"]
    assert got[1] == ["https://c.com/n/140626.docx", "https://c.com/n/140626 .docx", "https://c.com/n/140626 -.docx"] and got[2] == ["https://c.com/140626.pdf"] and got[3] == []


def test_blanks_round_items_go_and_digits_stay(spark):
    df = spark.createDataFrame([("0 one 0 \n1 two 1\n - 2 three ", "<b> 0 Ann </b><b>1 Bea 1</b>", "https://x.ie/0 ")], "t string, h string, u string")
    r = df.select(A.bullets(F.col("t")), X.found_names(F.col("h"), "<b>([^<]*)</b>"), U.seed_urls(F.col("u"), F.col("u"), F.lit(False))).first()
    assert r[0] == ["0 one 0", "1 two 1", "2 three"] and r[1] == ["0 Ann", "1 Bea 1"] and r[2][0] == "https://x.ie/0"
