import pytest
from pyspark.sql import functions as F

from lexmill.functions import python_text, text as T
from lexmill.operators import accuracy, association, collocations, density, feedback as fb, repetition, sophistication, taaled
from lexmill.operators.annotate import annotate


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def hand(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, sent_id int, pos int, text string, lower string, lemma string, upos string, tag string, dep string, head_pos int, is_stop boolean, is_punct boolean, ent_type string, in_coref boolean")


def token(pos, text, upos, tag, lemma=None, dep="dep", head=0, doc=1, **more):
    return (doc, 0, pos, text, text.lower(), lemma or text.lower(), upos, tag, dep, head, more.get("stop", False), upos == "PUNCT", more.get("ent", ""), more.get("coref", False))


def test_annotate_edges(spark):
    got = annotate(texts(spark, None, "", "  ", "The big dogs can run! 20 of them ran."))
    rows = got.where("doc_id = 3").orderBy("sent_id", "pos").collect()
    assert got.where("doc_id < 3").count() == 0
    assert [(r.text, r.tag, r.lemma) for r in rows[:5]] == [("The", "DT", "the"), ("big", "JJ", "big"), ("dogs", "NNS", "dog"), ("can", "MD", "can"), ("run", "VB", "run")]
    assert (rows[1].dep, rows[1].head_pos) == ("amod", 2) and rows[6].sent_id == 1 and rows[6].tag == "CD"


def test_first_sentence_keeps_its_digits(spark):
    assert texts(spark, "0 and 100. 10").select(T.sentences(F.col("text"))).first()[0] == ["0 and 100.", "10"]


def test_density_of_four_tokens(spark):
    t = hand(spark, token(0, "This", "DET", "DT"), token(1, "is", "VERB", "VBZ"), token(2, "a", "DET", "DT"), token(3, "tests", "NOUN", "NNS"))
    r = density.lexical_density(t).first()
    assert (r["LD_LXUR"], r["LD_GRUR"]) == (0.5, 0.0)


def test_contractions(spark):
    rows = texts(spark, "He's here, I´m not. They couldn't've gone; DON'T! rock 'n' roll", None, "i'm")
    got = [r[0] for r in rows.select(python_text.expand_contractions(F.col("text"))).collect()]
    assert got == ["He is here, I am not. They could notve gone; do not! rock  and  roll".replace("He is", "he is"), None, ""]
    assert [python_text.expanded(r.text) for r in rows.collect()] == got


def test_sophistication_counts_types_over_tokens(spark):
    t = hand(spark, *(token(i, w, "NOUN", "NN") for i, w in enumerate(["dog", "dog", "cat", "sun"])))
    words = {k: spark.createDataFrame([("dog",), ("dog",)], "word string") for k in ("NG", "NA", "TC", "BS")}
    ranked = spark.createDataFrame([(0, "dog", "NN", 10.0), (1, "cat", "NN", 20.0), (2, "cat", "NN", 2.0), (3500, "sun", "NN", 1.0)], "rank int, word string, tag string, freq double")
    r = sophistication.lexical_sophistication(t, words, {"CA": ranked, "CT": ranked, "CG": ranked}).first()
    assert r["LS_FPC_NG"] == 0.25 and r["LS_FPC_CA"] == 0.75 and r["LS_FPC_CGA1"] == 0.5 and r["LS_FPC_CGA2"] == 0.25 and r["LS_FPC_CGA3"] == 0
    assert r["LS_FOMN_TC"] == pytest.approx(16.0) and r["LS_FOMN_CA"] == 0


def test_content_and_function_words(spark):
    t = hand(spark, token(0, "He", "PRON", "PRP"), token(1, "quickly", "ADV", "RB"), token(2, "saw", "VERB", "VBD", "see"), token(3, "him", "PRON", "PRP"), token(4, "be", "VERB", "VB"), token(5, "zzz", "NOUN", "NN"))
    real = spark.createDataFrame([(w,) for w in ("he", "quickly", "saw", "him", "be")], "word string")
    got = taaled.classify(t, spark.createDataFrame([("quick",)], "word string"), real)
    assert [r.item for r in got.orderBy("pos").collect()] == ["he_fw", "quickly_cw", "see_cw_vb", "he_fw", "be_fw"]
    r = taaled.taaled_indices(got).first()
    assert r["TAALED_BASIC_NCONTENT_TOKENS"] == 2 and r["TAALED_BASIC_NFUNCTION_TYPES"] == 2


def test_collocations_rules(spark):
    assert collocations.coarse("ADJ+NOUN", "RB") == "ADJ" and collocations.coarse("NOUN+NOUN", "VBG") == "NOUN" and collocations.coarse("ADV+toVERB", "VB") == "toVERB"
    assert collocations.coarse("NOUN+VERB", "JJ") is None
    t = hand(spark, token(0, "big", "ADJ", "JJ", dep="amod", head=1), token(1, "dog", "NOUN", "NN", dep="nsubj", head=2), token(2, "eat", "VERB", "VB", dep="ROOT", head=2), token(3, "the", "DET", "DT", dep="det", head=1))
    got = collocations.collocations(t)
    assert sorted((r.lempos1, r.lempos2, r.type) for r in got.collect()) == [("big_ADJ", "dog_NOUN", "ADJ+NOUN"), ("dog_NOUN", "eat_VERB", "NOUN+VERB")]
    edges = spark.createDataFrame([("big_ADJ", "dog_NOUN", "ADJ+NOUN", 1.1, 5)], "lempos1 string, lempos2 string, type string, metric double, raw_freq long")
    m = collocations.with_metric(got, edges)
    r = collocations.collocation_indices(m).first()
    assert (r["LA_COL_ERR_R"], r["CA_BIN2"], r["CA_BIN2_R"], r["CA_BIN1"]) == (0.5, 1, 1.0, 0)
    s = association.scored(got, edges).where("o11 > 1").first()
    assert s.t == pytest.approx((5 - 5 * 5 / 5) / 5**0.5, abs=1e-6)


def test_spelling(spark):
    t = annotate(texts(spark, "the hoose is red. Bob likes it"))
    words = spark.createDataFrame([(w, 5.0) for w in ("the", "house", "is", "red", "likes", "it", "bob", "horse")], "word string, freq double")
    wrong = accuracy.spelling_errors(t, words)
    assert [r.lower for r in wrong.collect()] == ["hoose"]
    best = accuracy.corrections(wrong.select(F.col("lower").alias("word")), words)
    assert [tuple(r) for r in best.collect()] == [("hoose", "horse")]
    assert accuracy.correct_spelling(texts(spark, "the hoose"), best).first().text == "the horse "


def test_repetition_leaves_out_stop_words_and_punctuation(spark):
    t = hand(spark, token(0, "dog", "NOUN", "NN"), token(1, "dog", "NOUN", "NN"), token(2, "the", "DET", "DT", stop=True), token(3, "the", "DET", "DT", stop=True), token(4, ".", "PUNCT", "."), token(5, ".", "PUNCT", "."))
    assert [r.is_repetition for r in repetition.repetitions(t).orderBy("pos").collect()] == [True, True, False, False, False, False]


def test_feedback_covers_the_line(spark):
    rows = spark.createDataFrame([("L", "f", v) for v in (0.0, 1.0, 2.0, 3.0, 4.0)] + [("L", "LA_ER", 4.0), ("L", "zero", 0.0), ("L", "none", 1.0)], "level string, feature string, value double")
    known = spark.createDataFrame([("L", "f", 2.0, 1.0), ("L", "LA_ER", 2.0, 1.0), ("L", "zero", 0.0, 0.0)], "level string, feature string, mean double, std double")
    got = {(r.feature, r.value): (r.feedback, r.code) for r in fb.feedback(rows, known, ["level"]).collect()}
    assert [got["f", v] for v in (0.0, 1.0, 2.0, 3.0, 4.0)] == [("positive", -1), ("positive", -1), ("none", 0), ("negative", 1), ("negative", 1)]
    assert got["LA_ER", 4.0] == ("positive", -1) and got["zero", 0.0][1] == 0 and ("none", 1.0) not in got
    assert len(fb.VECTOR) == 35 and [fb.VECTOR[i] for i in (6, 28, 33)] == ["LV_HDD", "LA_ER", "LD_LXUR"]


#: For each pattern a head and a dependent by hand, with the dependency and what is to come out, dependent first.
BY_HAND = [
    ("run", "VBZ", "nsubj", "dog", "NN", "NOUN+VERB", "dog_NOUN", "run_VERB"), ("man", "NN", "acl", "sing", "VBG", "NOUN+VERB", "sing_VERB", "man_NOUN"),
    ("door", "NN", "compound", "car", "NN", "NOUN+NOUN", "car_NOUN", "door_NOUN"), ("car", "NNS", "amod", "red", "JJ", "ADJ+NOUN", "red_ADJ", "car_NOUN"),
    ("eat", "VBD", "dobj", "apple", "NNS", "VERB+NOUN", "apple_NOUN", "eat_VERB"), ("book", "NN", "relcl", "buy", "VBN", "VERB+NOUN", "buy_VERB", "book_NOUN"),
    ("go", "VB", "pobj", "school", "NN", "VERB+NOUN", "school_NOUN", "go_VERB"), ("look", "VBZ", "acomp", "good", "JJ", "VERB+ADJ", "good_ADJ", "look_VERB"),
    ("able", "JJ", "auxpass", "be", "VBD", "VERB+ADJ", "be_VERB", "able_ADJ"), ("want", "VBP", "xcomp", "swim", "VB", "VERB+VERB", "swim_VERB", "want_VERB"),
    ("speak", "VBZ", "advmod", "slowly", "RB", "ADV+VERB", "slowly_ADV", "speak_VERB"), ("how", "WRB", "xcomp", "cook", "VB", "ADV+toVERB", "cook_toVERB", "how_ADV"),
    ("easy", "JJ", "xcomp", "see", "VB", "ADJ+toVERB", "see_toVERB", "easy_ADJ"), ("cold", "JJ", "advmod", "very", "RB", "ADV+ADJ", "very_ADV", "cold_ADJ"),
]
INACTIVE = [
    ("way", "NN", "prep", "of", "IN", "NOUN+PREP", "of_PREP", "way_NOUN"), ("in", "IN", "pobj", "town", "NN", "PREP+NOUN", "town_NOUN", "in_PREP"),
    ("dog", "NN", "det", "that", "DT", "DET+NOUN", "that_DET", "dog_NOUN"), ("look", "VB", "prep", "for", "IN", "VERB+PREP", "for_PREP", "look_VERB"),
    ("afraid", "JJ", "prep", "of", "IN", "ADJ+PREP", "of_PREP", "afraid_ADJ"),
]


@pytest.mark.parametrize("active", (True, False))
def test_every_pattern_by_hand(spark, active):
    rows = []
    for doc, (head, head_tag, dep, word, tag, *_) in enumerate(BY_HAND + INACTIVE):
        rows += [token(0, head, "X", head_tag, dep="ROOT", head=0, doc=doc), token(1, word, "X", tag, dep=dep, head=0, doc=doc)]
    rows += [token(0, "dog", "X", "NN", dep="ROOT", doc=90), token(1, "the", "X", "DT", dep="nmod", doc=90), token(2, "dog", "X", "NN", dep="compound", doc=90), token(3, "odd", "X", "JJ", dep="punct", doc=90)]
    got = {r.doc_id: (r.type, r.lempos1, r.lempos2) for r in collocations.collocations(hand(spark, *rows), active_only=active).collect()}
    want = BY_HAND if active else BY_HAND + INACTIVE
    assert got == {doc: tuple(x[5:]) for doc, x in enumerate(want)}
    turned = {r.doc_id: r.lempos1 for r in collocations.collocations(hand(spark, *rows), direction_fix=True).collect()}
    assert turned[4] == "eat_VERB" and turned[0] == "dog_NOUN"


def test_heads_in_the_sentence_equal_the_self_join(spark):
    rows = texts(spark, "The big dogs can run quickly! We saw the old house in a small town.", "Dogs.", "", None)
    names = ["doc_id", "sent_id", "pos", "head_text", "head_lemma", "head_tag", "dep", "text", "lemma", "tag"]
    joined, looked_up = (sorted(map(tuple, collocations.dependencies(annotate(rows, heads=h)).select(names).collect())) for h in (False, True))
    assert joined == looked_up and len(joined) > 10
    from lexmill.operators.substitution import contexts
    assert sorted(map(tuple, contexts(annotate(rows)).collect())) == sorted(map(tuple, contexts(annotate(rows, heads=True)).collect()))


def test_collapsed_tags(spark):
    tags = "NN NNS NNP VB VBD MD JJR RBS WRB RP DT WDT PDT IN".split()
    got = spark.createDataFrame([(t,) for t in tags], "t string").select(collocations.collapsed_tag(F.col("t"))).collect()
    assert [r[0] for r in got] == "NN NN NN VB VB MD JJ RB RB RB DT DT DT IN".split()


def test_log_likelihood_by_hand(spark):
    import math

    edges = spark.createDataFrame([("a", "x", "T", 0.0, 10), ("a", "y", "T", 0.0, 5), ("b", "x", "T", 0.0, 3), ("b", "y", "T", 0.0, 20)], "lempos1 string, lempos2 string, type string, metric double, raw_freq long")
    pairs = spark.createDataFrame([(1, "a", "x", "T"), (1, "q", "x", "T")], "doc_id long, lempos1 string, lempos2 string, type string")
    got = {r.lempos1: r.g2 for r in association.log_likelihood(pairs, edges).collect()}
    o, r, c = [[10, 5], [3, 20]], [15, 23], [13, 25]
    assert got["a"] == pytest.approx(2 * sum(o[i][j] * math.log(o[i][j] * 38 / r[i] / c[j]) for i in (0, 1) for j in (0, 1))) and got["q"] == 0


def test_older_evaluator_codes_without_the_guard(spark):
    long = spark.createDataFrame([("A1", 1, "f", 0.0)], "level string, id long, feature string, value double")
    known = spark.createDataFrame([("A1", "f", 0.0, 0.0)], "level string, feature string, mean double, std double")
    assert [fb.feedback(long, known, ["level"], guard=g).first().code for g in (True, False)] == [0, 1]


def test_wrapped_mtld_equals_the_plain_search():
    import random

    def plain(w):
        lengths = []
        for s in range(len(w)):
            for size in range(10, len(w) + 1):
                if len({w[(s + k) % len(w)] for k in range(size)}) / size < 0.72:
                    lengths.append(size)
                    break
        return sum(lengths) / len(lengths) if lengths else 0.0

    dice = random.Random(2)
    for n in (0, 1, 9, 10, 25, 80):
        for kinds in (2, 12, 60, 10_000):
            w = [str(dice.randrange(kinds)) for _ in range(n)]
            assert taaled.mtld_wrap(w) == pytest.approx(plain(w))
    assert taaled.mtld_wrap([str(k) for k in range(20_000)]) == 0
