import random

import pytest

from almanac.llm.confusables import TextForm, lookalike_table
from almanac.llm.leaks import LeakFinder, SuffixAutomaton, bounded_items, decontaminated, leaked, words_of


@pytest.fixture(scope="module")
def table(spark):
    return lookalike_table(spark)


def test_automaton_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        items = [(i, [rng.choice("abc") for _ in range(rng.randint(1, 12))]) for i in range(rng.randint(1, 5))]
        least = rng.randint(1, 4)
        auto = SuffixAutomaton(items, least)
        text = [rng.choice("abcd") for _ in range(30)]
        found = auto.matches(auto.stream(text))
        inside = lambda w, x: any(x[k : k + len(w)] == w for k in range(len(x) - len(w) + 1))  # noqa: E731, B023
        for i, words in items:
            want = {}
            for e in range(1, 31):
                n = max((n for n in range(1, e + 1) if inside(text[e - n : e], words)), default=0)
                if n >= least:
                    want[e] = n
            assert {e: e - a for a, e in found.get(i, [])} == want


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"


def test_documents(spark, table):
    items = [(1, ITEM), (2, "short one"), (3, "zero " + ITEM), (4, "")]
    docs = [
        (1, "x " + " ".join(ITEM.split()[:12]) + " y", "en"), (2, " ".join(ITEM.split()[:11]), "en"), (3, None, None), (4, "", "x"), (5, ITEM.upper().replace(" ", "  –\n"), ""),
        (6, ITEM.replace("o", "о").replace("e", "e​"), ""), (7, "a " * 200_000 + ITEM, ""), (1, "x " + ITEM, "en"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string").selectExpr("*", "'q' AS id", "1 AS longest")
    got = sorted((r["doc_id"], r["item_id"], r["longest"]) for r in leaked(df, "doc_id", "text", [items], table).collect())
    assert got == [(1, 1, 12), (1, 1, 13), (1, 3, 12), (1, 3, 13), (5, 1, 13), (5, 3, 13), (6, 1, 13), (6, 3, 13), (7, 1, 13), (7, 3, 13)]
    assert leaked(df, "doc_id", "text", [], table).count() == leaked(df.limit(0), "doc_id", "text", [items], table).count() == 0


def test_removal(spark, table):
    df = spark.createDataFrame([(1, "keep this. " + ITEM + ". And very much more than that is said after it, so it stays."), (2, ITEM), (3, None), (4, "nothing")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in decontaminated(df, "doc_id", "text", [[(1, ITEM)]], table).collect()}
    assert out[1]["text"].split() == "keep this. And very much more than that is said after it, so it stays.".split() and out[1]["removed_words"] == 13
    assert out[2]["dropped"] and out[2]["text"] is None
    assert out[3]["text"] is None and not out[3]["dropped"] and out[4]["text"] == "nothing"
    f = LeakFinder([(1, ITEM)], TextForm(table))
    assert not f.find(out[1]["text"])[1]


def test_words_and_bound(spark, table):
    assert words_of("Ｔｈｅ O’Tresk’s 9.00 a_b", TextForm(table)) == ["the", "o", "tresk", "s", "9", "00", "a", "b"]
    some = spark.range(3).selectExpr("id", "'a b c' AS text")
    with pytest.raises(ValueError):
        bounded_items(some, "id", "text", most_bytes=100)
    assert bounded_items(some, "id", "text", group_words=6) == [[(0, "a b c"), (1, "a b c")], [(2, "a b c")]]
    assert bounded_items(some, "id", "text", group_words=1) == [[(i, "a b c")] for i in range(3)]
    assert bounded_items(some.limit(0), "id", "text") == []


def test_groups_give_what_one_gives(spark, table):
    other = "the quick brown fox jumps over the lazy dog and then it sleeps for hours"
    items = [(1, ITEM), (2, other), (3, "zero " + ITEM)]
    df = spark.createDataFrame([(1, f"a b c d e {ITEM} f g h {other} " + "i " * 60), (2, "x " * 40 + other), (3, None), (4, ITEM + " " + other)], "doc_id long, text string")
    one, three = ([*map(tuple, f(df, "doc_id", "text", g, table).collect())] for f in (leaked,) for g in ([items], [[i] for i in items]))
    assert sorted(one) == sorted(three) and len(one) == 7
    one, three = ([*map(tuple, decontaminated(df, "doc_id", "text", g, table).collect())] for g in ([items], [[i] for i in items]))
    assert sorted(one) == sorted(three) and [r[3] for r in sorted(one)] == [False, False, False, True]
