import random

import pytest

from almanac.llm.canonical import MANY, Matcher, Spelling, Trie, allowed, bounded_entries, candidates_in_list, map_to_list
from almanac.llm.confusables import TextForm, lookalike_table
from almanac.llm.queries import PARISH_NAMES

NAMES = ["Carrowzolane (St Évrin)", "Carrowzolane (St Corvan)", "Derryfelish West", "Derryfelish East", "Kiltrastor", "Drumfeligo – Doonfelymph", "Ardlughuss (Immaculate Conception)", "Maglughlough", "Fennsketúss", "Українська капеланія Друмшел"]
ENTRIES = [(101 + i, n) for i, n in enumerate(NAMES)]


@pytest.fixture(scope="module")
def matcher(spark):
    return Matcher(ENTRIES, TextForm(lookalike_table(spark)), PARISH_NAMES)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("carrowzolane st evrin", 101), ("St Corvan, Carrowzolane", 102), ("Parish of Carrowzolane (St. Évrin) - Newsletter", 101), ("Derryfelish Wst", 103), ("Derryfelsh East Parish", 104),
        ("KILTRASTOR RC Church", 105), ("Ki1trast0r", 105), ("Kiltrastоr", 105), ("Doonfelymph & Drumfeligo", 106), ("Drumfeligo agus Doonfelymph", 106), ("Ardlughuss (Imm. Conc.)", 107), ("Maglughloch", 108),
        ("Fennsketuss Paris", 109), ("Українська, капеланія Друмшел", 110), ("Drumfeligo – Doonfe", 106), ("Kiltrastor (new site) - Newsletter", 105),
        ("Weekly bulletin", 0), ("unknown", 0), ("Ballyeast", 0), ("Derryfelish", 0), ("Carrowzolane", 0), ("?", 0), ("x" * 1_000_000, 0),
    ],
)
def test_what_a_text_means(matcher, text, want):
    assert matcher.best(text) == want


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_automaton_against_brute_force():
    rng = random.Random(5)
    words = [(i, "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))) for i in range(150)]
    trie = Trie(words)
    for _ in range(300):
        t = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 10)))
        for most in range(4):
            want = {i: d for i, w in words if (d := distance(w, t)) <= most}
            assert trie.search(t, most) == want
            begun = {}
            for n in range(10):
                for i, w in words:
                    if len(w) >= n and (d := distance(w[:n], t)) <= most:
                        begun.setdefault(w[:n], [d, set()])
            got = trie.search(t, most, True)
            for p, (d, refs) in begun.items():
                refs |= {i for i, w in words if w.startswith(p)}
            singles = {next(iter(refs)): min(d for d, r in begun.values() if r == refs) for _, refs in begun.values() if len(refs) == 1}
            assert {r: d for r, d in got.items() if r != MANY} == singles
            many = [d for d, refs in begun.values() if len(refs) > 1]
            assert got.get(MANY) == (min(many) if many else None)


def test_all_entries_within_the_distance(matcher):
    near = matcher.candidates("Carrowzolane (St Evran)")
    assert near[0] == (1, 101) and near == sorted(near) and {r for _, r in near} <= {101, 102}
    assert allowed(3) == 0 and allowed(20) == 3


def test_nearest_are_the_first_candidates(matcher):
    for t in ("Carrowzolane (St Evran)", "Derryfelish Est", "Derryfelish", "Kiltrastr", "Maglughloh", "?", "Drumfeligo", "Carrowzolane St"):
        near = matcher.candidates(t)
        assert matcher.nearest(t) == [x for x in near if x[0] == near[0][0]]


def test_table(spark):
    df = spark.createDataFrame([(1, "Kiltrastor "), (2, None), (3, "  "), (4, ""), (5, "Kiltrastor "), (6, "no such"), (7, "　")], "row_id long, display_name string")
    df = df.selectExpr("*", "row_id AS ref_id", "'x' AS nearest", "'y' AS __m")
    out = sorted((r["row_id"], r["ref_id"]) for r in map_to_list(df, "display_name", ENTRIES, lookalike_table(spark), PARISH_NAMES).collect())
    assert out == [(1, 105), (5, 105), (6, 0)]
    assert map_to_list(df.limit(0), "display_name", ENTRIES, lookalike_table(spark), PARISH_NAMES).count() == 0
    assert {r["ref_id"] for r in map_to_list(df, "display_name", [], lookalike_table(spark)).collect()} == {0}


def test_candidates(spark, matcher):
    df = spark.createDataFrame([("Carrowzolane (St Evran)",), ("Carrowzolane (St Evran)",), ("Drumfeligo – Doon",), ("?",), (None,), ("Derryfelish Est",)], "display_name string").selectExpr("*", "1 AS distance")
    got = {}
    for r in candidates_in_list(df, "display_name", ENTRIES, lookalike_table(spark), PARISH_NAMES).collect():
        got.setdefault(r["display_name"], []).append((r["distance"], r["ref_id"], r["beginning"]))
    assert got["Drumfeligo – Doon"] == [(0, 106, True)] and set(got) == {"Carrowzolane (St Evran)", "Drumfeligo – Doon", "Derryfelish Est"}
    for t, near in got.items():
        assert sorted(near) == [(d, r, b) for found, b in [matcher.found(t)] for d, r in found]


def test_without_rules_only_edits_count(spark):
    m = Matcher([(1, "north lane"), (2, "south lane")], TextForm(lookalike_table(spark)))
    assert m.best("North Lane") == 1 and m.best("nrth lane") == 1 and m.best("weekly") == 0 and Spelling().letters(["i1"]) == "i1"


def test_bound(spark):
    df = spark.range(5).selectExpr("id", "string(id) AS name")
    with pytest.raises(ValueError):
        bounded_entries(df, "id", "name", limit=4)
