from collections import Counter
from math import comb

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.operators import variation as v

WORDS = st.lists(st.sampled_from("abcdefgh"), max_size=90)


def one(spark, text):
    return v.lexical_variation(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


def test_six_sentences_have_forty_words(spark):
    text = (
        "Why don't you buy that red hut. I think you should buy that orange summer skirt. The orange summer skirt is nice and is cheap. "
        "How about the purple top? The purple top expensive. The red hut is cheap."
    )
    assert one(spark, text)["LV_W"] == 40


def test_two_lexical_tokens(spark):
    rows = spark.createDataFrame([(1, ["is", "tests"])], "doc_id long, w array<string>")
    got = v.lexical_variation(rows, text=None, sequence=F.col("w")).first()
    want = dict(LV_W=2, LV_WT=2, LV_WT1=2, LV_TTR=1.0, LV_CTTR=1.0, LV_RTTR=1.414213562373095, LV_HDD=0.0, LV_DUGA=0, LV_MAAS=0, LV_SUMM=1.0, LV_YULEK=0.0, LV_MTLD=2.0, LV_MSTTR=2, LV_MATTR=2)
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_null_blank_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, " \n", "x"), (3, "a b a", "x"), (3, "a b a", "x")], "doc_id long, text string, LV_W string")
    got = sorted(tuple(r) for r in v.lexical_variation(rows).collect())
    assert got[0][1:] == got[1][1:] == (0,) * 14
    assert got[2] == got[3] and got[2][1:3] == (3, 2)
    assert v.lexical_variation(rows.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(WORDS)
def test_windows_against_brute_force(w):
    n = len(w)
    if n <= 25:
        assert v.mattr(w) == v.msttr(w) == n
        return
    windows = [len(set(w[i : i + 25])) / 25 for i in range(n - 24)]
    assert v.mattr(w) == pytest.approx(sum(windows) / len(windows))
    parts = [len(set(w[i * 25 : i * 25 + 25])) / 25 for i in range(n // 25)]
    assert v.msttr(w) == pytest.approx(sum(parts) / len(parts))


@settings(max_examples=80, deadline=None)
@given(WORDS)
def test_hypergeometric_index(w):
    n = len(w)
    want = sum(1 - comb(n - f, 35) / comb(n, 35) for f in Counter(w).values()) / 35 if n >= 35 else 0
    assert v.hdd(list(Counter(w).values()), n) == pytest.approx(want)


@settings(max_examples=80, deadline=None)
@given(WORDS)
def test_mtld_against_slices(w):
    def slow(x):
        full, start = 0.0, 0
        for end in range(1, len(x) + 1):
            if len(set(x[start:end])) / (end - start) < 0.72:
                full, start = full + 1, end
        if start < len(x):
            full += (1 - len(set(x[start:])) / (len(x) - start)) / 0.28
        return len(x) / full if full else len(x)

    assert v.mtld(w) == pytest.approx((slow(w) + slow(w[::-1])) / 2 if w else 0)


def test_very_long_text(spark):
    got = one(spark, "word other thing " * 70_000)
    assert got["LV_W"] == 210_000 and got["LV_WT"] == 3 and got["LV_MATTR"] == pytest.approx(3 / 25)
