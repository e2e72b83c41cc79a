"""Queries and operators do the whole job: nothing is left out to keep a check small."""

import numpy as np
import pytest

from lexmill.operators import accuracy, mutation
from lexmill.operators.annotate import annotate
from lexmill.plans import queries as q, sql as S
from lexmill.plans.pipeline import Pipeline, Resources


def test_every_vector_gives_a_pair(spark, tmp_path):
    rng = np.random.default_rng(1)
    vec = {i: rng.normal(size=4).astype("float32") for i in range(12)}
    rows = [(i, [float(x) for x in v], i % 4) for i, v in vec.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.pair: r for r in q.queries()["substitution_scores"](spark, str(tmp_path)).collect()}
    assert set(got) == set(vec)
    away = lambda a, b: 1 - float(np.dot(a, b)) / float(np.linalg.norm(a) * np.linalg.norm(b))
    for i, v in vec.items():
        near = [away(v, vec[i + k]) for k in (2, 3, 5) if i + k in vec]
        if i + 1 not in vec or not near:
            assert got[i]["add"] == got[i].bal_add == got[i].mult == got[i].bal_mult == -1
            continue
        d, n = away(v, vec[i + 1]), len(near)
        logs = sum(np.log((x + 1) / 2) for x in near)
        assert got[i]["add"] == pytest.approx((d + sum(near)) / (n + 1), abs=1e-5)
        assert got[i].bal_add == pytest.approx((n * d + sum(near)) / (2 * n), abs=1e-5)
        assert got[i].mult == pytest.approx(np.exp((np.log((d + 1) / 2) + logs) / (n + 1)), abs=1e-5)
        assert got[i].bal_mult == pytest.approx(np.exp((n * np.log((d + 1) / 2) + logs) / (2 * n)), abs=1e-5)


def test_collocations_are_looked_for_in_preprocessed_texts(spark):
    known = "they like big dogs the could eat not but do".split()
    edges = [("big_ADJ", "dog_NOUN", "ADJ+NOUN", 1.1, 5), ("like_VERB", "they_NOUN", "NOUN+VERB", 2.0, 5)]
    r = Resources(
        dictionary=spark.createDataFrame([(w,) for w in known], "word string"),
        edges=spark.createDataFrame(edges, "lempos1 string, lempos2 string, type string, metric double, raw_freq long"),
    )
    rows = spark.createDataFrame([(1, "Big dogs."), (2, "They like \"biig dogs\"."), (3, "Biig dogs."), (4, None), (5, "")], "doc_id long, text string")
    got = {x.doc_id: x for x in Pipeline(r).collocational_aspects().lexical_accuracy().transform(rows).collect()}
    assert (got[1].CA_BIN2, got[1].LA_COL_ERR_R, got[1].LA_E) == (1, 0.0, 0)
    assert [(got[i].CA_BIN2, got[i].LA_COL_ERR_R) for i in (2, 3)] == [(1, 0.0)] * 2 and got[3].LA_E == 1  # errors are counted in the text as it is
    assert len(got) == 5


def test_preprocessing_reaches_words_beside_punctuation(spark):
    known = spark.createDataFrame([(w,) for w in ("house", "is", "not", "red", "the")], "word string")
    rows = spark.createDataFrame([(1, "The hoose, isn't red. Huose!"), (1, "hoose"), (None, "(hoose)"), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in accuracy.preprocessed(rows, known).collect()}
    assert {(1, "house"), (None, "(house)"), (2, None)} < got
    assert any(t and t.startswith("The house, is not red. ") for _, t in got)


def test_revision_takes_synonyms_beyond_the_first_twenty(spark):
    rows = spark.createDataFrame([(1, "dog " * 31), (2, "The dog saw a dog."), (3, "cat " * 4)], "doc_id long, text string")
    syn = [("dog", f"hound{chr(97 + i // 6)}{chr(97 + i % 6)}", 1.0) for i in range(36)] + [("cat", "dog", 2.0), ("cat", "hound", 1.0)]
    synonyms = spark.createDataFrame(syn[::-1], "lemma string, synonym string, score double")
    got = {r.doc_id: r.text.split() for r in mutation.revise(annotate(rows), synonyms).collect()}
    assert got[1] == [s for _, s, _ in syn[:30]] + ["dog"]  # ties by synonym
    assert got[2] == ["The", "houndaa", "saw", "a", "dog."] and got[3] == ["dog", "hound", "cat", "cat"]
    assert {r.doc_id: r.text.split() for r in mutation.revise(annotate(rows), synonyms, first=1).collect()} == got


def test_synonyms_are_not_capped(spark):
    found = spark.createDataFrame([("w0_NOUN", f"w{i}_NOUN", "NOUN+NOUN") for i in range(1, 31) for _ in range(2)], "lempos1 string, lempos2 string, type string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(q.collocations, "collocations", lambda t: found)
        got = q._synonyms(None)
    assert got.where("lemma = 'w0'").count() == 30 and got.where("synonym = 'w0'").count() == 30


def test_short_texts_are_outliers(spark, tmp_path):
    texts = {1: "a b c d", 2: " ".join(f"{chr(97 + i)}x" for i in range(10)), 3: "the cat " * 15, 4: " ".join(f"w{chr(97 + i // 20)}{chr(97 + i % 20)}" for i in range(60)), 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in q.queries()["outliers"](spark, str(tmp_path)).collect()) == [1, 2, 3, 5]


def test_models_run_with_their_defaults(spark, monkeypatch):
    rows = [(i, "A1", float(i % 5), *(float((i * (k + 3)) % 17 + (i % 5) * (k + 1)) for k in range(len(S.FEATURES)))) for i in range(200)]
    made = spark.createDataFrame(rows, "id long, level string, grade double, " + ", ".join(f"{f} double" for f in S.FEATURES))
    monkeypatch.setattr(q, "features", lambda *a: made)
    folds = q.queries()["cross_validation"](spark, "").collect()
    assert sorted(r.fold for r in folds) == list(range(10))
    got = q.queries()["validation_summary"](spark, "").first()
    r = np.array([f.r for f in folds])
    assert got["mean"] == pytest.approx(r.mean()) and got.twice_std == pytest.approx(2 * r.std())
    seen = {}
    monkeypatch.setattr(q, "_predicted", lambda spark, sf, make: seen.update(rounds=make.getStages()[-1].getClassifier().getMaxIter()))
    q.linear_classifier(spark, "")
    assert seen["rounds"] == 20


def test_swapped_letters_and_two_errors_are_corrected(spark):
    known = spark.createDataFrame([("because", 5), ("became", 90), ("house", 3), ("is", 9)], "word string, freq long")
    wrong = ["becuase", "becuasse", "ebcuase", "hxuxe", "hxxxe", "bcause", "a", "x" * 500]
    got = {r.word: r.best for r in accuracy.corrections(spark.createDataFrame([(w,) for w in wrong], "word string"), known).collect()}
    assert got == {"becuase": "because", "becuasse": "because", "ebcuase": "because", "hxuxe": "house", "bcause": "because", "a": "is"}
