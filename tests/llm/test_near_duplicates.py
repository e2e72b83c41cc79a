import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import _minhash as M
from lexmill.llm._graph import components
from lexmill.llm.near_duplicates import NearDuplicates, band_plan


def sets(rows, words, least):
    out = {}
    for i, t in rows:
        w = re.findall(r"[\w']+", (t or "").lower())
        if len(w) >= least:
            out[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
    return out


def made(seed=1, n=60):
    dice = random.Random(seed)
    rows = []
    for i in range(n):
        w = [dice.choice("abcdefghijklmnopqrstuvwxyz") * dice.randint(1, 4) for _ in range(dice.randint(20, 80))]
        rows.append((10 * i, " ".join(w)))
        for k in range(dice.choice((0, 0, 1, 3))):
            v = list(w)
            for _ in range(dice.randint(0, 6)):
                v[dice.randrange(len(v))] = "edit"
            rows.append((10 * i + k + 1, " ".join(v).upper() + ("!" if k else "")))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = made() + [(9001, None), (9002, ""), (9003, "too short"), (9004, "Ünïcode wörds häve tö cöunt " * 5), (9005, "ünïcode, wörds häve tö cöunt " * 5)]
    rows += rows[:5]  # delivered again
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id long, essay string, node string, key int")
    got = {(r.id_a, r.id_b) for r in NearDuplicates(table, "id", "essay", words=3, threshold=0.5, least=20).pairs().collect()}
    s = sets(rows, 3, 20)
    want = {(a, b) for a in s for b in s if a < b and 2 * len(s[a] & s[b]) >= len(s[a] | s[b])}
    assert got <= want and len(want - got) <= 0.02 * len(want) and (9004, 9005) in got


def test_groups_and_hot_copies(spark):
    rows = [(i, "the same long text of one hot group again and again for all") for i in range(200)] + [(500, "another text that nobody else has ever written down before now")]
    near = NearDuplicates(spark.createDataFrame(rows, "id long, text string"))
    got = near.groups().collect()
    assert len(got) == 200 and {r.group_id for r in got} == {0} and {r.links for r in got} == {0}
    assert near.links.count() == 0


def test_very_long_texts(spark):
    dice = random.Random(9)
    w = [str(dice.randrange(10**6)) for _ in range(60_000)]
    v = w[:30_000] + ["changed"] + w[30_001:]
    near = NearDuplicates(spark.createDataFrame([(1, " ".join(w)), (2, " ".join(v)), (3, " ".join(reversed(w)))], "id long, text string"))
    assert [(r.id_a, r.id_b) for r in near.pairs().collect()] == [(1, 2)]


def test_empty_table(spark):
    near = NearDuplicates(spark.createDataFrame([], "id long, text string"))
    assert near.pairs().count() == 0 and near.groups().count() == 0


def test_signature_estimates_jaccard():
    dice = random.Random(3)
    a = [str(dice.random()) for _ in range(300)]
    texts = [" ".join(a), " ".join(a[:200] + [str(dice.random()) for _ in range(100)]), "", "one"]
    data = pa.array(texts).cast(pa.large_string())
    with np.errstate(over="ignore"):
        h, of, counts = M.shingles(np.frombuffer(data.buffers()[2], np.uint8), np.frombuffer(data.buffers()[1], np.int64), 1)
        table = M.signatures(h, of, 4, 256)
    assert counts.tolist()[2:] == [0, 1] or counts[2] == 0
    x, y = set(re.findall(r"\S+", texts[0])), set(re.findall(r"\S+", texts[1]))
    assert (table[0] == table[1]).mean() == pytest.approx(len(x & y) / len(x | y), abs=0.1)
    assert len(set((table[3] >> np.uint64(48)).tolist())) == 256  # one element ranks all lanes differently


def test_portions_keep_long_texts_whole():
    texts = pa.array(["a" * 10, None, "b" * 5000, "c", "d"])
    assert list(M.portions(texts, rows=2, size=100)) == [(0, 2), (2, 3), (3, 5)]


def test_band_plan_is_sensitive_at_the_threshold():
    for t in (0.5, 0.8):
        bands, rows = band_plan(t)
        assert (1 - t**rows) ** bands <= 0.021


def test_components(spark):
    dice = random.Random(5)
    edges = [(dice.randrange(400), dice.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_are_never_broadcast(spark, monkeypatch):
    """With default settings, whatever the optimizer believes of the size of the signed texts."""
    from lexmill.llm import near_duplicates as N

    plans, kept = [], N.stored
    monkeypatch.setattr(N, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    rows = made(3, 20)
    N.NearDuplicates(spark.createDataFrame(rows, "id long, text string"), words=3, threshold=0.5)
    banded = [p for p in plans if "_last" in p]
    assert len(banded) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in banded)


@pytest.mark.parametrize("block", (1, 3, 2000))
def test_hot_bands_are_divided_without_a_lost_pair(spark, monkeypatch, block):
    """One third of the texts are edits of one text, so that their bands are far larger than a block."""
    from lexmill.llm import near_duplicates as N

    monkeypatch.setattr(N, "BLOCK", block)
    dice = random.Random(4)
    base = [str(dice.randrange(999)) for _ in range(60)]
    rows = [(i, " ".join(w if k != i % 50 + 3 else "edit" for k, w in enumerate(base)) + f" end{i}") for i in range(20)]
    rows += [(1000 + i, " ".join(str(dice.randrange(999)) for _ in range(40))) for i in range(40)]
    got = {(r.id_a, r.id_b) for r in N.NearDuplicates(spark.createDataFrame(rows, "id long, text string"), words=3, threshold=0.5).pairs().collect()}
    assert got == {(a, b) for a in range(20) for b in range(a + 1, 20)}


def test_representatives(spark):
    text = "a text of some words that is handed in by many people of one class again and again until the very end of the year"
    rows = [(i, text) for i in range(5)] + [(9, text + " today"), (20, "nobody else has written this other text about a very small bird")]
    links, members = NearDuplicates(spark.createDataFrame(rows, "id long, text string")).representatives()
    assert [(r.id_a, r.id_b) for r in links.collect()] == [(0, 9)]
    assert {(r.id, r.representative) for r in members.collect()} == {*((i, 0) for i in range(5)), (9, 9)}
