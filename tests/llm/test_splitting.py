import random

import numpy as np
import pytest

from almanac.llm.splitting import Splitter, bounded_profiles, merge, split_texts
from almanac.llm.tokens import ByteTokenizer

PROFILES = [("a", 20, 4), ("b", 64, 0), ("c", 7, 6)]


def brute(sizes, strengths, limit, first):
    segs, b, ids = list(sizes), list(strengths), list(range(len(strengths)))
    while True:
        best = min(((b[i], segs[i] + segs[i + 1], ids[i], i) for i in range(len(b)) if segs[i] + segs[i + 1] <= (limit if i else first)), default=None)
        if best is None:
            return ids
        i = best[3]
        segs[i : i + 2] = [segs[i] + segs[i + 1]]
        del b[i], ids[i]


def test_merging_against_brute_force():
    rng = random.Random(4)
    for k in range(3000):
        n = rng.randint(1, 20)
        sizes, strengths = [rng.randint(1, 9) for _ in range(n)], [rng.randint(0, 3) for _ in range(n - 1)]
        first = 20 + k % 3 * 6
        assert merge(sizes, strengths, 20, first) == brute(sizes, strengths, 20, first)


TEXTS = [
    "One sentence here. Another one, with a clause; and more! " * 9 + "\n\n" + "A second paragraph.\r\n\r\n  Third line\nfourth line " * 8,
    "x" * 3000, "日本語テキスト" * 100, "😀" * 90, " " * 500, "\n" * 300, "word " * 400, "“Quoted.” Said Ann… then ‘left.’ Bob stayed. " * 30,
]


@pytest.mark.parametrize("text", TEXTS)
def test_limits_overlaps_and_round_trip(text):
    tk = ByteTokenizer()
    sizes = tk.sizes(text)
    ends, data = np.cumsum(sizes), text.encode()
    starts = ends - sizes
    rows = Splitter(tk).pieces(text, PROFILES)
    for name, most, overlap in PROFILES:
        own = [r for r in rows if r[0] == name]
        if len(sizes) <= most:
            assert not own
            continue
        assert [r[1] for r in own] == list(range(len(own)))
        assert own[0][2] == 0 and own[-1][3] == len(sizes)
        back = b""
        for k, (_, _, a, b, n, shared, at, chars, _, piece) in enumerate(own):
            assert text[at : at + len(piece)] == piece or "\ufffd" in piece
            assert chars == len(data[starts[a] : starts[a + shared]].decode("utf-8", "ignore"))
            assert n == b - a
            assert n <= most or len(piece) == 1 or overlap >= most - 3
            if k:
                assert a + shared == own[k - 1][3]
                assert shared <= overlap and (shared == overlap or data[starts[a] - 1] & 0x80 or a - 1 < 0 or own[k - 1][3] - overlap < 0)
            back += data[starts[a + shared] : ends[b - 1]]
        assert back == data


def test_natural_boundaries_come_first():
    text = "First paragraph is here.\n\nSecond paragraph is here. It has two sentences.\n\nThird."
    n = len(ByteTokenizer().encode(text))
    rows = Splitter(ByteTokenizer()).pieces(text, [("p", n - 1, 0)])
    assert [r[8] for r in rows] == ["paragraph", "end"]


def cuts(text, most, overlap=0):
    return [(r[8], r[9]) for r in Splitter(ByteTokenizer()).pieces(text, [("p", most, overlap)])]


def test_first_piece_has_the_whole_limit():
    text = " ".join(f"Sentence number {i} is here." for i in range(40))
    own = [r for r in Splitter(ByteTokenizer()).pieces(text, [("p", 60, 20)])]
    assert own[0][4] > 40 and max(r[4] for r in own) <= 60


@pytest.mark.parametrize(
    ("text", "end"),
    [
        ("我们今天在教堂里见面。请大家带上自己的书和午餐。" * 4, "。"), ("来てください！ありがとうございました？はい" * 6, "！？"), ("これは「本です。」と彼は言った" * 8, "」"),
        ("a line without stops\ranother of the same kind\r" * 8, "\rd"), ("यह एक वाक्य है।यह दूसरा वाक्य है।" * 6, "।"),
    ],
)
def test_boundaries_without_blanks(text, end):
    got = cuts(text, 40)
    assert len(got) > 1 and all(kind in ("sentence", "line") for kind, _ in got[:-1])
    assert all(piece.rstrip("\r")[-1] in end for _, piece in got[:-1])


def test_lone_returns_make_paragraphs():
    assert cuts("One two three four.\r\rFive six seven eight nine ten.", 12)[0] == ("paragraph", "One two three four.\r\r")
    assert cuts("One two three four.\r\nFive six seven eight nine ten.", 12)[0] == ("line", "One two three four.\r\n")


def test_abbreviations_end_no_sentence():
    text = "We met Fr. John at St. Mary by the Co. Down road with J. Smith and others there. Then we all went home again to eat."
    got = cuts(text, 26)
    assert got[0][1].endswith("there.") and got[0][0] == "sentence"
    assert all(kind != "sentence" or piece.rstrip()[-5:] in ("here.", " eat.") for kind, piece in cuts(text, 9))


def test_table(spark):
    df = spark.createDataFrame([(1, TEXTS[0], "z"), (2, None, "z"), (3, "", None), (4, "short", "z"), (1, TEXTS[0], "z")], "doc_id long, text string, profile string").selectExpr("*", "1 AS id", "2 AS piece")
    out = split_texts(df, "doc_id", "text", PROFILES, ByteTokenizer())
    assert {r["doc_id"] for r in out.collect()} == {1}
    assert out.count() == 2 * len(Splitter(ByteTokenizer()).pieces(TEXTS[0], PROFILES))
    assert split_texts(df.limit(0), "doc_id", "text", PROFILES, ByteTokenizer()).count() == 0
    assert split_texts(df, "doc_id", "text", [], ByteTokenizer()).count() == 0
    limits = spark.createDataFrame([("a", 10, 3), ("b", 5, 9), ("c", None, 1), ("d", 0, 1), ("e", 8, None), (None, 5, 1), ("f", 6, -2)], "profile string, max_tokens int, overlap_tokens int")
    assert bounded_profiles(limits) == [("a", 10, 3), ("b", 5, 4), ("e", 8, 0), ("f", 6, 0)]
