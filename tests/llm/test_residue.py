import pytest

from almanac.llm.queries import HARVEST_RULES
from almanac.llm.residue import ResidueRules, residue_values, templates, without_residue

BAD = {
    "placeholder": ["{{ key }}", "${parish}", "%(week)s", "<%= reason %>", "@@err@@", "Bulletins/raw/kilmore_[parish].pdf", "Bulletins/raw/__n__.pdf", "Bulletins/raw/kilmore___status__.pdf",
                    "[object Object]", "undefined", "Bulletins/raw/undefined.pdf", "%s failed after %d attempts", "Bulletins/raw/kilmore%s.pdf", "Failed with code <<code>> on <<host>>", "Reason: TODO fill in reason", "a/YYYY-MM-DD.pdf", "{diocese}", "#{url}", "$key$"],
    "filler": ["xxxxxx", "foo bar baz", "test test test", "Dolor ipsum sit amet...", "Sample text goes here", "lorem-ipsum.pdf"],
    "page": ["<h1>It works!</h1>", "404 - Page not found", "Error 502 nginx", "Please enable JavaScript to continue.", "Seite nicht gefunden", "Veuillez activer JS pour continuer", "  JUST A MOMENT... CHECKING YOUR BROWSER \n", "Access denied", "This site can’t be reached"],
}
FINE = ["", "  ", "pdf", "HTTP 404 returned for kilmore.example", 'Unexpected response {"code": 429, "retry": 20}', "Selector a[href*='2025-10'] matched nothing on kilmore.test", "Page not found while following step 3 of the recipe (HTTP 404)",
        'Recipe for Kilmore [St Ann) no longer fits the site; start the trainer with "Kilmore"', "Bulletins/raw/kilmore[4]_final.pdf", "Bulletins/raw/kilmore_100%25_2026-03-16.pdf", "/srv/x/kilmore%20notices.pdf",
        "Bulletins/raw/kilmore_test_results_evening.pdf", "Bulletins/raw/kilmore_javascript_class.pdf", "Bulletins/raw/kilmore_404_bus_route.pdf", "Navigation timeout of 109000 ms exceeded", "No DNS answer for kilmore.test"]


@pytest.fixture(scope="module")
def frame(spark):
    values = [(v, k) for k, vs in BAD.items() for v in vs] + [(v, None) for v in FINE] + [(None, None)]
    rows = [(i, "kilmore", v, k, "z", 1) for i, (v, k) in enumerate(values)]
    return spark.createDataFrame(rows, "result_id long, key string, error string, want string, h string, template int")


def test_every_value_gets_its_verdict(frame):
    got = {r["result_id"]: r["verdict"] for r in residue_values(frame, "result_id", ["error"], "key", HARVEST_RULES).collect()}
    for r in frame.collect():
        assert got.get(r["result_id"]) == r["want"], r["error"]


def test_repeated_ids_and_empty(spark, frame):
    twice = residue_values(frame.unionByName(frame), "result_id", ["error"], "key", HARVEST_RULES)
    assert twice.count() == twice.select("result_id", "field").distinct().count() == sum(map(len, BAD.values()))
    assert residue_values(frame.limit(0), "result_id", ["error"], "key").count() == 0


def test_null_source_and_statistics(spark):
    df = spark.createDataFrame([(1, None, "{{x}}", "pdf", "keep"), (2, "abcd", "fine", "TBD", "keep")], "result_id long, key string, error string, file_type string, __bad string")
    out = {r["result_id"]: r for r in without_residue(df, "result_id", ["error", "file_type"], "key").collect()}
    assert {r["__bad"] for r in out.values()} == {"keep"}
    assert out[1]["error"] is None and out[1]["file_type"] == "pdf" and out[2]["file_type"] is None and out[2]["error"] == "fine"


def test_templates_merge_numbers_addresses_and_keys(spark):
    rows = [(i, f"src{i:04d}", f"No DNS answer for host{i}.example after {i} s at src{i:04d}") for i in range(50)]
    t = templates(spark.createDataFrame(rows, "result_id long, key string, error string"), ["error"], "key", id_col="result_id").collect()
    assert len(t) == 1 and t[0]["n_rows"] == 50 and t[0]["widely"] and t[0]["verdict"] is None


def test_sources_are_counted_exactly(spark):
    words = lambda t: "".join(chr(97 + int(c)) for c in f"{t:04d}")
    rows = [(t * 100 + i, k, f"notice {words(t)}") for t in range(400) for i, k in enumerate([f"s{t}-{j}" for j in range(5)] + [f" S{t}-0 ", None])]
    rows += [(100_000 + i, f"p{i}", "seen by four") for i in range(4)] + [(100_010, "p0", "seen by four")]
    got = templates(spark.createDataFrame(rows, "result_id long, key string, error string"), ["error"], "key", id_col="result_id").collect()
    assert {(r["n_sources"], r["n_rows"], r["widely"]) for r in got if r["template"] != "seen by four"} == {(5, 7, True)} and len(got) == 401
    assert [(r["n_sources"], r["n_rows"], r["widely"]) for r in got if r["template"] == "seen by four"] == [(4, 5, False)]


def test_rules_are_parameters_and_recurrence_is_reported(spark):
    rows = [(i, f"k{i % 6}", "our own words about {{x}}") for i in range(12)] + [(50, "k1", "gone fishing")]
    df = spark.createDataFrame(rows, "result_id long, key string, error string")
    got = {(r["result_id"], r["verdict"], r["widely"]) for r in residue_values(df, "result_id", ["error"], "key").collect()}
    assert got == {(i, "placeholder", True) for i in range(12)}
    own = ResidueRules(quoting=((r"^(our own words about ).+", "$1quoted"),), pages=("^gone fishing$",), recurring=7)
    assert {(r["result_id"], r["verdict"], r["widely"]) for r in residue_values(df, "result_id", ["error"], "key", own).collect()} == {(50, "page", False)}
