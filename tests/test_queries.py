"""Every query with SQL against DuckDB on the smallest tables, the others for running."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registered():
    assert set(SQL) <= set(QUERIES)
    assert {"p4_found", "p5_found"} <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["table_name", "station", "snapshot_date", "key", "change"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert compare(df, con, SQL[name]) == ""
    else:
        df.write.format("noop").mode("overwrite").save()


def test_recipes_have_every_result(spark, con):
    steps = """SELECT key, run_id, count(*) AS n, string_agg(CASE status WHEN 'ok' THEN 'download' WHEN 'html_link' THEN 'html' WHEN 'skipped' THEN 'goto' ELSE 'click' END, '>' ORDER BY result_id) AS flow
     FROM (SELECT DISTINCT * EXCLUDE key, lower(trim(key)) AS key FROM (SELECT result_id, run_id, seq, key, display_name, status, url, file_name, file_exists, file_type, error, is_fallback, is_stale, stale_reason, retry_strategy, fetched_at FROM fetch_results)) WHERE key IS NOT NULL GROUP BY 1, 2"""
    got = QUERIES["recipe_fingerprints"](spark, SF)
    assert compare(got.selectExpr("key", "run_id", "n_steps AS n", "flow"), con, steps) == ""
    whole = QUERIES["recipe_standalone"](spark, SF)
    # all steps but the leading goto that was put in front, and the terminal ones before the last
    ends = "('download', 'html', 'image')"
    want = f"""SELECT key, run_id, len(a) - greatest(len(list_filter(a, lambda x: x IN {ends})) - 1, 0) + CASE WHEN a[1] = 'goto' THEN 0 ELSE 1 END AS n FROM (SELECT key, run_id, string_split(flow, '>') AS a FROM ({steps}))"""
    assert compare(whole.selectExpr("key", "run_id", "size(steps) AS n"), con, want) == ""


def test_p5_found_goes_through_the_cascade(spark, con, monkeypatch):
    from almanac.plans import harvest

    ran, cascade = [], harvest.orphan_cascade
    monkeypatch.setattr(harvest, "orphan_cascade", lambda *a, **k: ran.append(1) or cascade(*a, **k))
    assert compare(harvest.p5_found(spark, SF), con, SQL["p5_found"]) == "" and ran
