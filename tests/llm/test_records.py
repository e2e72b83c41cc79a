import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm._tokens import token_count
from lexmill.llm.consensus import Consensus, digamma, krippendorff, log_gamma
from lexmill.llm.mixing import Mix
from lexmill.llm.packing import pack, pack_histogram, places_by_rank
from lexmill.llm.sampling import Reservoirs, priority, proportional_sample, usable_cells
from lexmill.llm.splits import author_groups, hot_join, split_groups, split_report


def test_digamma(spark):
    got = spark.range(1).select(*(F.expr(digamma(f"{x}D")).alias(str(i)) for i, x in enumerate((1.0, 0.5, 10.0)))).first()
    assert list(got) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525891], abs=1e-8)
    got = spark.range(1).select(*(F.expr(log_gamma(f"{x}D")).alias(str(i)) for i, x in enumerate((1.0, 0.5, 10.0, 300.5)))).first()
    assert list(got) == pytest.approx([math.lgamma(x) for x in (1.0, 0.5, 10.0, 300.5)], abs=1e-6)


def test_consensus_finds_bad_annotators(spark):
    dice = random.Random(2)
    rows = []
    for item in range(400):
        truth = dice.randrange(5)
        for rater in dice.sample(("good", "fine", "inverse", "random", "okay"), 3):
            label = {"inverse": 4 - truth, "random": dice.randrange(5)}.get(rater, min(4, max(0, truth + dice.choice((0, 0, 0, 1, -1)))))
            rows.append((item, rater, label, 1))
    rows += [(None, "good", 1, 1), (5, None, 1, 1), (5, "good", 9, 1), (5, "fine", None, 1)]
    model = Consensus(spark.createDataFrame(rows, "item long, rater string, label int, weight long"), 5)
    r = {x.rater: x for x in model.reliability().collect()}
    assert {k for k, x in r.items() if x.slope_high < 0.5} == {"inverse", "random"}
    assert all(x.accuracy_low <= x.accuracy <= x.accuracy_high for x in r.values()) and model.consensus().count() == 400


def test_class_shares_are_of_items(spark):
    """Items with one label and with three count alike, and a pattern counts as often as its items."""
    rows = [(i, "a", 0, 50) for i in range(2)] + [(10 + i, r, 2, 20) for i in range(5) for r in "abc"]
    model = Consensus(spark.createDataFrame(rows, "item long, rater string, label int, weight long"), 3)
    assert sum(model.shares) == pytest.approx(100 + 100 + 3) and model.shares[2] == pytest.approx(101, abs=12)


def test_consensus_without_rows(spark):
    none = spark.createDataFrame([], "item long, rater string, label int, weight long")
    model = Consensus(none, 5)
    assert model.reliability().count() == 0 and model.consensus().count() == 0
    assert krippendorff(none).first().alpha_interval is None


def test_krippendorff_by_hand(spark):
    rows = [(1, "a", 1, 1), (1, "b", 1, 1), (2, "a", 2, 1), (2, "b", 2, 1), (3, "a", 3, 1), (3, "b", 1, 1), (4, "a", 0, 1)]
    r = krippendorff(spark.createDataFrame(rows, "item long, rater string, label int, weight long")).first()
    values = [1, 1, 2, 2, 3, 1]
    observed = 2 * (3 - 1) ** 2 / 6
    expected = sum((x - y) ** 2 for x in values for y in values) / (6 * 5)
    assert r.pairable == 6 and r.alpha_interval == pytest.approx(1 - observed / expected)


def test_sample_meets_quotas(spark):
    rows = [(i, "B 1.1" if i % 3 else "CEFR A1,2", [" 1,5", "2.0", "4", "-", None, "9"][i % 6], "x") for i in range(600)]
    table = spark.createDataFrame(rows + rows[:50], "id long, level string, vocab_grade_avg string, have string")
    targets = spark.createDataFrame([("B1.1", "low", 100, 5), ("B1.1", "mid", 800, 5), ("A1.2", "low", 50, 7), ("A1.2", "high", 50, 5)], "level string, vocab_band string, target_permille long, min_rows long")
    cells = usable_cells(table, targets)
    have = Counter((r.level, r.vocab_band) for r in cells.collect())
    n = sum(have.values()) // 2
    sample, report = proportional_sample(cells, targets)
    got = Counter((r.level, r.vocab_band) for r in sample.collect())
    assert len({r.id for r in sample.collect()}) == sum(got.values())
    for r in report.collect():
        cell = (r.level, r.vocab_band)
        quota = max({"low": 7 if r.level == "A1.2" else 5}.get(r.vocab_band, 5), n * {("B1.1", "low"): 100, ("B1.1", "mid"): 800}.get(cell, 50) // 1000)
        assert (r.have, r.quota, r.taken, r.exhausted) == (have[cell], quota, min(quota, have[cell]), have[cell] < quota) and got[cell] == r.taken
    sample, report = proportional_sample(cells.limit(0), targets)
    assert sample.count() == 0 and report.where("exhausted").count() == 4


def test_reservoirs_are_bounded_and_mergeable(spark):
    """One cell holds most rows: no task keeps more than its bound, and the drawn rows are the smallest priorities of all."""
    rows = spark.range(0, 20_000, 1, 8).select("id", F.lit("B1.1").alias("level"), F.when(F.col("id") % 10 == 0, "low").otherwise("mid").alias("vocab_band"))
    bounds = spark.createDataFrame([("B1.1", "mid", 100), ("B1.1", "low", 5000)], "level string, vocab_band string, most long")
    kept = Reservoirs(rows, ["level", "vocab_band"], bounds)
    assert kept.rows.where("vocab_band = 'mid'").count() <= 8 * 100 and kept.rows.where("vocab_band = 'low'").count() == 2000
    assert {r.vocab_band: r.have for r in kept.counts.collect()} == {"mid": 18_000, "low": 2000}
    drawn = kept.trim(bounds.withColumnRenamed("most", "quota")).where("vocab_band = 'mid'")
    want = rows.where("vocab_band = 'mid'").orderBy(priority(F.col("id")), "id").limit(100)
    assert {r.id for r in drawn.collect()} == {r.id for r in want.collect()}


STUDENTS = [(1, "Müller", "Ann Bea"), (2, "Berg", "Bob"), (3, "Zed", "Cleo"), (4, "Mueller", "Ann"), (5, "Solo", "Dora"), (None, "X", "Y"), (6, None, "Z")]


def authors(spark, rows):
    students = spark.createDataFrame(STUDENTS + STUDENTS[:1], "student_id long, nachname string, vorname string")
    accounts = spark.createDataFrame([(1, "Kurs  Raum")], "account_id long, account_name string")
    return author_groups(spark.createDataFrame(rows, "id long, session string, student string, label string"), students, accounts)


def test_author_groups(spark):
    rows = [
        (1, "Session 1", "ann  MULLER", "x"), (2, None, "Berg, Bob", "x"), (3, "1", "Ann Bea Müller & Bob Berg", "x"), (4, "1", "Dora Solo", "x"), (5, "S07", "SEAT 00042", "x"), (6, "Session 7", "Platz Nr. 42", "x"),
        (7, None, "Seat 42", "x"), (8, "2", " kurs raum ", "x"), (9, "2", None, "x"), (10, "2", "?", "x"), (11, "2", "Cleo Zed und Nobody Known", "x"), (4, "1", "Dora Solo", "x"), (12, "3", "", "x"),
    ]
    got = {r.id: r.group_key for r in authors(spark, rows).collect()}
    assert got == {1: "stu-1", 2: "stu-1", 3: "stu-1", 4: "stu-5", 5: "seat-42-7", 6: "seat-42-7", 8: "acc-1", 11: "stu-3"}
    assert authors(spark, rows[:0]).count() == 0


def test_splits_keep_groups_and_shares(spark):
    dice = random.Random(4)
    rows = [(i, f"g{dice.randrange(800)}" if i % 4 else "hot", dice.choice("ABC")) for i in range(8000)]
    targets = spark.createDataFrame([("train", 800), ("validation", 100), ("test", 100)], "split_name string, target_permille long")
    out = split_groups(spark.createDataFrame(rows, "id long, group_key string, label string"), targets).collect()
    where = defaultdict(set)
    for r in out:
        where[r.group_key].add(r.split_name)
    assert len(out) == 8000 and all(len(x) == 1 for x in where.values())
    sizes = Counter(r.split_name for r in out)
    assert sizes["train"] == pytest.approx(6400, rel=0.03) and sizes["test"] == pytest.approx(800, rel=0.2)
    assert split_groups(spark.createDataFrame([], "id long, group_key string, label string"), targets).count() == 0


def test_split_report(spark):
    dice = random.Random(5)
    rows = [(i, f"g{dice.randrange(900)}" if i % 3 else "hot", dice.choice("AAB")) for i in range(9000)]
    targets = spark.createDataFrame([("train", 800), ("validation", 100), ("test", 100), ("none", 0)], "split_name string, target_permille long")
    groups = spark.createDataFrame(rows, "id long, group_key string, label string")
    got = {r.split_name: r for r in split_report(split_groups(groups, targets), groups, targets).collect()}
    assert sum(r.records for r in got.values()) == 9000 and got["none"].records == 0 and got["none"].label_deviation is None
    assert all(abs(got[k].actual_permille - got[k].target_permille) < 25 and got[k].label_deviation < 40 for k in ("train", "validation", "test"))


def test_hot_join_loses_and_repeats_nothing(spark):
    rows = spark.range(0, 3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 4, None).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"))
    known = rows.select("key").distinct().where("key <> 'k5'").withColumn("v", F.concat("key", F.lit("!")))
    want = rows.join(known, "key").select("id", "key", "v")
    assert sorted(map(tuple, hot_join(rows, known, "key").select("id", "key", "v").collect())) == sorted(map(tuple, want.collect()))
    assert hot_join(rows.limit(0), known, "key").count() == 0


def test_packing_places_every_token_once(spark):
    dice = random.Random(6)
    items = [(i, dice.choice((1, 5, 60, 99, 100, 101, 250, dice.randrange(1, 400)))) for i in range(700)] + [(9000, 0), (9001, None)]
    got = pack(spark.createDataFrame([(i, n, "x") for i, n in items], "doc_id long, n_tokens long, piece string"), 100).collect()
    used, whole = Counter(), Counter()
    for r in got:
        used[r.container] += r.n_tokens
        whole[r.doc_id] += r.n_tokens
    assert max(used.values()) <= 100 and whole == {i: n for i, n in items if n} and sorted(used) == list(range(len(used)))
    assert all(sum(r.doc_id == i for r in got) == -(-n // 100) for i, n in items[:50])
    assert sum(used.values()) / (100 * len(used)) > 0.95
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 100).count() == 0


def test_histogram_packing_counts():
    histogram = {7: 10, 5: 3, 3: 1000, 1: 4}
    packed = pack_histogram(histogram, 10)
    placed = Counter()
    for count, pattern in packed:
        assert sum(n * k for n, k in pattern) <= 10
        for n, k in pattern:
            placed[n] += count * k
    assert placed == histogram
    for length, n in histogram.items():
        ranks = sorted({(r[3], r[4]) for r in places_by_rank(packed) if r[0] == length})
        assert ranks[0][0] == 0 and ranks[-1][1] == n and all(x[1] == y[0] for x, y in zip(ranks, ranks[1:]))


def test_mix_reaches_targets(spark):
    dice = random.Random(8)
    items = [(i, "ab"[i % 2] if i % 10 else "c", dice.randrange(1, 200)) for i in range(5000)] + [(9000, None, 5), (9001, "a", None), (9002, "other", 3)]
    table = spark.createDataFrame(items, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 600, 3), ("b", 200, 2), ("c", 195, 1), ("none", 5, 2)], "source string, target_permille long, max_repeats long")
    mix = Mix(table, targets)
    report = {r.source: r for r in mix.report().collect()}
    assert report["a"].actual_permille == pytest.approx(600, abs=25) and report["b"].actual_permille == pytest.approx(200, abs=15)
    assert not report["c"].reachable and not report["none"].reachable and report["a"].reachable
    assert report["c"].mix_tokens == report["c"].have_tokens
    copies = mix.copies().collect()
    assert max(r.copies for r in copies if r.source == "a") <= 3 and {r.copies for r in copies if r.source == "c"} == {1}
    assert Mix(table.limit(0), targets).copies().count() == 0


def test_token_counts(spark):
    rows = spark.createDataFrame([("hello world",), (None,), ("",)], "text string")
    assert [r[0] for r in rows.select(token_count(F.col("text"))).collect()] == [2, 0, 0]
