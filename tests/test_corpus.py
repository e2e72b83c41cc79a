import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import session
from lexmill.operators import curation, lexicon, mutation, ratings, statistics as st, substitution
from lexmill.operators.annotate import annotate
from lexmill.operators.feedback import VECTOR
from lexmill.plans.pipeline import Pipeline
from lexmill.sources import readers, sinks


def test_spearman_with_ties(spark):
    rows = spark.createDataFrame([("g", a, b) for a, b in [(1, 3), (1, 1), (2, 2), (3, 5), (3, 5), (None, 4)]], "g string, a int, b int")
    ranks = lambda x: np.array([np.mean([i + 1 for i, y in enumerate(sorted(x)) if y == v]) for v in x])
    want = np.corrcoef(ranks([1, 1, 2, 3, 3]), ranks([3, 1, 2, 5, 5]))[0, 1]
    assert st.spearman(rows, "a", "b", ["g"]).first().rho == pytest.approx(want)


def test_correlation_without_variation_is_null(spark):
    rows = spark.createDataFrame([("g", "f", 1.0, 2.0), ("g", "f", 1.0, 3.0), ("h", "f", 1.0, 2.0), ("h", "f", 2.0, 4.0), ("h", "f", None, 9.0)], "g string, feature string, value double, t double")
    got = {r.g: r.r for r in st.pearson(rows, "t", ["g"]).collect()}
    assert got["g"] is None and got["h"] == pytest.approx(1.0)


def test_kappa_and_intraclass(spark):
    pairs = spark.createDataFrame([("d", float(a), float(b)) for a, b in [(0, 0), (1, 2), (2, 2), (4, 2), (4, 4)]], "dimension string, a double, b double")
    index = {0: 0, 1: 1, 2: 2, 4: 3}
    o, n = np.zeros((4, 4)), 5
    for r in pairs.collect():
        o[index[r.a], index[r.b]] += 1
    w = np.subtract.outer(range(4), range(4)) ** 2
    want = 1 - (w * o).sum() / (w * np.outer(o.sum(1), o.sum(0)) / n).sum()
    assert ratings.weighted_kappa(pairs, ["dimension"]).first().kappa == pytest.approx(want)
    x = np.array([[r.a, r.b] for r in pairs.collect()])
    rows, cols = x.mean(1, keepdims=True), x.mean(0, keepdims=True)
    msr = 2 * ((rows - x.mean()) ** 2).sum() / 4
    mse = ((x - rows - cols + x.mean()) ** 2).sum() / 4
    assert ratings.intraclass(pairs, ["dimension"]).first().icc3k == pytest.approx((msr - mse) / msr)
    assert ratings.weighted_kappa(pairs.limit(0), ["dimension"]).count() == 0


def test_enriched_needs_one_student(spark):
    essays = spark.createDataFrame([(1, "Ann X", "Session 1"), (2, "Bob Y", "Session 1"), (3, "ann x", "Session 9")], "id long, name string, session string")
    students = spark.createDataFrame([("ANN X", "A1"), ("Bob Y", "A1"), ("bob y", "B1")], "name string, level string")
    prompts = spark.createDataFrame([("A1", "Session 1", "T", "D")], "level string, session string, title string, text string")
    grades = spark.createDataFrame([("Nobody", 3.0)], "name string, overall double")
    got = sorted((r.id, r.title, r.overall) for r in curation.enriched(essays, students, prompts, grades).collect())
    assert got == [(1, "T", "N/A"), (3, None, "N/A")]


def test_leave_one_out_and_clauses(spark):
    rows = spark.createDataFrame([(1, "One two. Three! Four five six seven eight nine ten."), (2, None), (3, "")], "doc_id long, text string")
    got = {r.sent_id: r.text for r in mutation.leave_one_out(rows).collect()}
    assert got[1] == "One two. Four five six seven eight nine ten." and len(got) == 3
    parts = {(r.sent_id, r.clause_id): r.clause for r in mutation.clauses(rows).collect()}
    assert parts == {(0, -1): None, (1, -1): None, (2, 0): "Four five six seven eight nine"}


def test_revision_uses_each_synonym_once(spark):
    from lexmill.operators.annotate import annotate

    rows = spark.createDataFrame([(1, "The dog saw a dog. The dog slept.")], "doc_id long, text string")
    syn = spark.createDataFrame([("dog", "hound", 0.9), ("dog", "cur", 0.5)], "lemma string, synonym string, score double")
    text = mutation.revise(annotate(rows), syn).first().text
    assert text.count("hound") == text.count("cur") == text.count("dog") == 1 and text.index("cur") < text.rindex("dog")


def test_substitutability_without_vectors(spark):
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "key string, vec array<float>")
    pairs = spark.createDataFrame([(1, "a", "b", ["c", "x"]), (2, "a", "x", ["c"]), (3, "a", "b", ["x"])], "pair long, synonym string, target string, contexts array<string>")
    got = {r.pair: r for r in substitution.substitutability(pairs, vec, vec).collect()}
    c = 1 - 0.5**0.5
    assert got[1]["add"] == pytest.approx((1 + c) / 2) and got[1].bal_mult == pytest.approx((1 * (c + 1) / 2) ** 0.5)
    assert got[2]["add"] == got[3].mult == -1


def test_marked_target(spark):
    r = spark.sql("SELECT 'were deeply čšscepticalčš about' AS s").select(substitution.marked_target(F.col("s")).alias("t")).first().t
    assert r.target == "sceptical" and r.before == "were deeply "


def test_pipeline_resolves_needs_once():
    p = Pipeline().lexical_accuracy().lexical_accuracy().collocational_aspects()
    assert p.get_pipe() == ["spell_checker", "collocation_preprocessor", "collocation_detector", "collocation_evaluator", "lexical_accuracy", "collocational_aspects"]


def test_full_vector_has_35_columns(spark):
    p = Pipeline().lexical_variation().lexical_sophistication().lexical_accuracy().collocational_aspects().lexical_density()
    got = p(spark, "This is just some random text")
    assert got.columns[1:36] == VECTOR and got.count() == 1


def test_full_vector_is_made_in_parts(spark):
    """The plan of the row only joins stored parts: no annotation is left in it, and the tokens are not kept."""
    rows = spark.createDataFrame([(k, f"The big dog saw {k} small cats. They don't run quickly and they don't sleep.") for k in range(4)] + [(4, None), (5, " ")], "doc_id long, text string")
    p = Pipeline().lexical_variation().lexical_density().lexical_accuracy().collocational_aspects().association_scores()
    before = session.written()
    out = p.lexical_variation_taaled().repetition_detector().component("n", lambda t: t.groupBy("doc_id").count()).transform(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and len(plan) < 50_000
    assert not [x for x in session.written() - before if "lexmill_" in x] and not spark.sql("SHOW TABLES LIKE 'lexmill_*'").count()
    assert out.columns[-3:] == ["repeated", "repeated_words", "count"]
    got = {r.doc_id: r for r in out.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5] and got[0]["count"] == 17 and got[4]["count"] is None
    for one, names in ((Pipeline().lexical_density(), ["LD_LXUR", "LD_GRUR"]), (Pipeline().lexical_variation(), ["LV_W", "LV_MTLD", "LV_YULEK"])):
        assert {r.doc_id: tuple(r[c] for c in names) for r in one.transform(rows).collect()} == {k: tuple(r[c] for c in names) for k, r in got.items()}


def test_long_word_lists_do_not_shuffle_the_tokens(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "The quick dog ran quickly. I don't like 3 historic dogs historically."), (2, "A slow cat sleeps slowly and oddly.")], "doc_id long, text string")
    p = Pipeline().taaled_token_classifier().lexical_variation_taaled()
    want = {r.doc_id: r for r in p.transform(rows).collect()}
    monkeypatch.setattr(lexicon, "SMALL", 6)
    assert {r.doc_id: r for r in p.transform(rows).collect()} == want and "historically_cw" in want[1].content_words and "quickly_cw" not in want[1].content_words and "oddly_cw" not in want[2].content_words
    tokens = annotate(rows)
    items, real = lexicon.without(tokens, lexicon.dictionary(rows, least=1), lambda make: make())
    assert real is None and sorted({r.lower for r in tokens.collect()} - {r.lower for r in items.collect()}) == [".", "3", "don't"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Essay,Vocab_Grade_AVG,Level\n"one\ntwo, ""x""",2.5,A1.1\nno grade,N/A,A1.1\nother level,3,A2.2\n,3,A1.1\nodd,3.x,A1.1\n')
    assert [tuple(r) for r in readers.graded_csv(spark, str(tmp_path / "a.csv")).collect()] == [('one two, "x"', 2.5, "A1.1")]
    (tmp_path / "level_B1.xml").write_text("<writings><writing><grade>90</grade><text>a &amp;amp; b</text></writing><writing><grade>3</grade></writing></writings>")
    assert [tuple(r)[:3] for r in readers.writings_by_level(spark, str(tmp_path)).collect()] == [("B1", 90, "a & b")]
    (tmp_path / "Ann X_1_onlinetext.html").write_text("<p>Hello&nbsp;<b>you</b>\n there</p>")
    assert [tuple(r) for r in readers.html_essays(spark, str(tmp_path)).collect()] == [("Ann X", "Hello\xa0 you there")]
    (tmp_path / "e.txt").write_text("king 1 0.5\nqueen 0.25 2\n")
    assert [r.vec for r in readers.embeddings(spark, str(tmp_path / "e.txt")).orderBy("key").collect()] == [[1.0, 0.5], [0.25, 2.0]]
    known = spark.createDataFrame([("f", 1, 0.5, 0.1), ("g", 2, 1.5, 0.2)], "feature string, feature_index int, mean double, std double")
    sinks.write_threshold_json(known, str(tmp_path / "t.json"))
    sinks.write_threshold_xml(known, str(tmp_path / "bin_values_level_b1.xml"))
    assert sorted(tuple(r) for r in readers.threshold_json(spark, str(tmp_path / "t.json")).collect()) == [("f", 0.5, 0.1), ("g", 1.5, 0.2)]
    assert sorted(tuple(r) for r in readers.threshold_xml(spark, str(tmp_path / "bin_values_level_b1.xml")).collect()) == [("b1", 1, 0.5, 0.1), ("b1", 2, 1.5, 0.2)]


def test_components_show_what_they_make(spark, tmp_path):
    rows = spark.createDataFrame([(1, "The dog saw him. He don't like biig dogs dogs dogs.", "a"), (2, None, "b")], "doc_id long, text string, who string")
    p = Pipeline().spell_checker().coreference().collocation_preprocessor().collocation_detector().taaled_token_classifier()
    out = {r.doc_id: r for r in p.pipe(rows, as_tuples=True, save_period=1, save_to=str(tmp_path / "out")).collect()}
    assert out[1].context_who == "a" and out[2].context_who == "b" and out[1].coreferent_tokens == 2 and "biig" in out[1].spell_errors
    assert "He" in out[1].preprocessed_text and "'" not in out[1].preprocessed_text and out[1].content_words and out[2].preprocessed_text is None
    assert len(list((tmp_path / "out").glob("*.parquet"))) >= 2
    with pytest.raises(ValueError):
        p.ask("nothing")
    with pytest.raises(ValueError):
        p.pipe(rows, save_period=5)


def test_first_writings_follow_the_file(spark, tmp_path):
    for f in "ab":
        (tmp_path / f"{f}.xml").write_text("<writings>" + "".join(f"<writing id='{k}'><level>A1</level><grade>{k}</grade><text>{f}{k} &amp;amp; more</text></writing>" for k in range(30)) + "<writing><grade>1</grade></writing></writings>")
    got = readers.first_writings(spark, [str(tmp_path / "a.xml"), str(tmp_path / "b.xml")], 3).collect()
    assert sorted((r.level, r.grade, r.text) for r in got) == sorted(("A1", k, f"{f}{k} & more") for f in "ab" for k in range(3))


def test_ranks_come_from_a_column_where_there_is_one(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "1.csv").write_text("rank,word,SpaCy tag,COCA-Acad\n3,c,NN,1\n")
    (tmp_path / "l" / "2.csv").write_text('rank,word,SpaCy tag,COCA-Acad\n1,a,NN,"1,000"\n2,b,NN,5\n')
    assert sorted((r.rank, r.word) for r in readers.ranked_list(spark, str(tmp_path / "l")).collect()) == [(0, "a"), (1, "b"), (2, "c")]
