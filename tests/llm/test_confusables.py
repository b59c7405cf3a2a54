import pandas as pd
import pytest

from almanac.llm.confusables import TextForm, consistent_names, lookalike_table, name_forms


@pytest.fixture(scope="module")
def tf(spark):
    return TextForm(lookalike_table(spark))


def disguised(tf, text):
    own = tf.form(text)
    return not tf.plain(text) and tf.plain(own) and tf.skeleton(own) == tf.skeleton(text)


@pytest.mark.parametrize(
    ("text", "form", "hidden"),
    [
        ("Lisjartór (St Évrin)", "Lisjartór (St Évrin)", False),
        ("Aghnafeӏfin", "Aghnafelfin", True),
        ("Ｋｎｏｃｋ　Ｅａｓｔ", "Knock East", True),
        ("Dérry", "Dérry", True),
        ("Temple​jari‎sh", "Templejarish", True),
        ("Rath Mor", "Rath Mor", True),
        ("Ιmmaculate", "Immaculate", True),
        ("Ϲlon", "Clon", True),
        ("n/а", "n/a", True),
        ("Українська капеланія", "Українська капеланія", False),
        ("Укpаїнська", "Українська", True),
        ("Our Lady’s – Well", "Our Lady’s – Well", False),
        ("Kn0ck1igg", "Kn0ck1igg", False),
        ("  two  blanks ", "  two  blanks ", False),
        ("", "", False),
        ("♣", "♣", False),
    ],
)
def test_single_texts(tf, text, form, hidden):
    assert tf.form(text) == form
    assert disguised(tf, text) is hidden
    assert tf.fold_text(text) == form


def test_equal_looking_names_get_equal_forms(spark):
    rows = pd.DataFrame(
        {"id": range(7), "display_name": ["Kilmore", "Kilmоre", "Kilmore", None, "", "Kil more", "Kil more"], "display_name_form": "old", "form": "x", "skeleton": 1, "n": 2, "__text": "y"}
    )
    df = spark.createDataFrame(rows)
    out = {r["id"]: r for r in consistent_names(df, lookalike_table(spark)).collect()}
    assert len(out) == 7
    assert {out[i]["display_name_form"] for i in (0, 1, 2)} == {"Kilmore"}
    assert out[3]["display_name_form"] is None and out[3]["display_name_disguised"] is False
    assert out[4]["display_name_form"] == ""
    assert out[5]["display_name_form"] == out[6]["display_name_form"] == "Kil more"
    assert [out[i]["display_name_disguised"] for i in range(7)] == [False, True, False, False, False, False, True]
    assert out[0]["form"] == "x" and out[0]["skeleton"] == 1


def test_ties_go_to_the_smallest_plain_member(spark):
    df = spark.createDataFrame([("a’b",), ("a'b",)], "display_name string")
    forms = {r["form"] for r in name_forms(df, lookalike_table(spark)).collect()}
    assert forms == {"a'b"}


def test_empty_table_and_long_text(spark):
    t = lookalike_table(spark)
    assert consistent_names(spark.createDataFrame([], "display_name string"), t).count() == 0
    long = "Ａ" * 200_000
    row = consistent_names(spark.createDataFrame([(long,)], "display_name string"), t).first()
    assert row["display_name_form"] == "A" * 200_000 and row["display_name_disguised"]


@pytest.mark.parametrize(("text", "form"), [("ꓐallymore", "Ballymore"), ("Ꮶnockꓰast", "KnockEast"), ("Kilꮃood", "Kilwood"), ("\U00010513orth", "North"), ("ꓡismore", "Lismore")])
def test_look_alikes_of_all_alphabets(tf, text, form):
    assert tf.form(text) == form and disguised(tf, text) and tf.skeleton(text) == tf.skeleton(form) and tf.fold_text(text) == form


@pytest.mark.parametrize("pair", ["ЗƷ", "πᴨ", "βß", "пᴨ", "кĸ", "τᴛ"])
def test_prototypes_of_any_kind(tf, pair):
    assert tf.skeleton(pair[0]) == tf.skeleton(pair[1]) and tf.skeleton("x" + pair[0]) == tf.skeleton("x" + pair[1])


def test_neighbours_at_any_distance(tf):
    for long in ("щ" * 46, "ща"):
        assert tf.form(long + " сор") == long + " сор"
        assert tf.form("сор " + long) == "сор " + long
        assert tf.form(long + "1" * 60 + " сор") == long + "1" * 60 + " сор"
    assert tf.form("cab сор") == "cab cop"


def test_found_by_the_plain_member_of_the_group(spark):
    # the rewritten text is not plainly typed itself, but a member of its group is
    df = spark.createDataFrame([("Weiß",), ("Weiβ",), ("Weiβ♣",), ("Kilmоre",), ("Зіма",)], "display_name string")
    got = {r["display_name"]: (r["disguised"], r["form"]) for r in name_forms(df, lookalike_table(spark)).collect()}
    assert got["Weiß"] == (False, "Weiß") and got["Weiβ"] == (True, "Weiß") and got["Kilmоre"] == (True, "Kilmore")
    assert not got["Weiβ♣"][0] and not got["Зіма"][0]
