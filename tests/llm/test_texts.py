import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.llm._figures import Figures
from lexmill.llm._labelled import labelled
from lexmill.llm.quality import RULE_FIGURES, RuleList, prose_rules, quality
from lexmill.llm.readability import reading_levels
from lexmill.llm.spam import spam_pages

PROSE = "We went to the old house because it was raining and nobody wanted to stay in the garden. They said that it would be better in the evening. "


def test_rules_hold_on_documents_they_have_not_seen():
    texts, junk = labelled(500, seed=77)
    f = Figures()(pa.array(texts))
    assert (prose_rules().predict(f) == np.array(junk)).mean() >= 0.95


def test_rule_list_learns_and_becomes_sql(spark):
    dice = np.random.default_rng(1)
    x = {"a": dice.random(800), "b": dice.random(800)}
    junk = (x["a"] < 0.3) | (x["b"] >= 0.8)
    rules = RuleList.learn(x, junk)
    assert (rules.predict(x) == junk).mean() > 0.95
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x["a"], x["b"])], "a double, b double")
    assert [r[0] == "junk" for r in rows.select(F.expr(rules.sql())).collect()] == rules.predict(x).tolist()
    assert RuleList.learn(x, np.zeros(800, bool)).sql() == "'prose'"


def test_quality_kinds(spark):
    rows = [
        (1, PROSE * 3), (2, PROSE.lower().replace(".", "").replace(" ", "\n") * 3), (3, "\n".join(f"- item{i} thing" for i in range(20))), (4, None), (5, ""), (6, "Too short."),
        (7, "Wenn das Wetter schön ist, gehen wir in den Garten und ich lese mit meiner Schwester ein Buch, weil sie es mag. " * 3), (8, PROSE * 20_000), (1, PROSE * 3),
    ]
    got = {r.id: r.kind for r in quality(spark.createDataFrame([(i, t, 0.0) for i, t in rows], "id long, essay string, words double")).collect()}
    assert got == {1: "prose", 2: "prose", 3: "junk", 4: "short", 5: "short", 6: "short", 7: "prose", 8: "prose"}
    assert quality(spark.createDataFrame([], "id long, essay string")).count() == 0


def test_figures_of_words():
    f = Figures()(pa.array(["The banana, made twice.\nNot  49!", None, "  "]))
    assert Figures()(pa.array(["don't a_b c", "d"]))["runs"].tolist() == [5, 1]
    assert f["words"].tolist() == [6, 0, 0] and f["runs"].tolist() == [6, 0, 0] and f["lines"][0] == 2 and f["ended_lines"][0] == 1.0
    assert f["syllables"][0] == 1 + 3 + 1 + 1 + 1 + 1 and set(RULE_FIGURES) <= set(f)


def test_markup_of_any_length_is_no_word():
    long = '<a href="' + "x" * 5000 + '" class="big one">'
    f = Figures()(pa.array([f"One {long}two</a> three &nbsp;&#8212; four<br/>", "i <love you and all of them :> five", "open <b and &", "; gt > end", "a &amp b; c"]))
    assert f["words"].tolist() == [4, 8, 3, 2, 4]


LEVELS = {
    "A1": "I have a dog. He is big. We run in the park. ", "A2": "Last summer we went to the village and they found some pictures of the old river. ",
    "B1": "After the lesson the teacher decided that we should organise another meeting about our holiday plans. ",
    "B2": "Although responsible companies encourage education, many citizens are worried that pollution could increase in developing regions. ",
    "C1": "Notwithstanding the considerable resistance of institutions, it is often the administrators who systematically misrepresent the indispensable foundations of accountability. ",
}


def test_levels_do_not_rise_with_missing_punctuation(spark):
    rows = [(i * 10 + k, lv, text * 12) for i, (lv, text) in enumerate(LEVELS.items()) for k in range(6)]
    rows += [(900, "A1", (LEVELS["A1"] * 12).replace(".", "")), (901, "A1", LEVELS["C1"] * 6), (902, None, None), (903, "A1", "Kurz."), (904, "B1", "Wir haben ein Buch und ich lese es mit dem Bruder in der Schule. " * 9)]
    table = spark.createDataFrame(rows, "id long, level string, essay string")
    got = {r.id: r.text_band for r in reading_levels(quality(table).join(table.select("id", "level"), "id")).collect()}
    assert got[900] == "A1" and got[901] == "C1" and got[902] is None and got[903] is None and got[904] is None
    assert [got[i * 10] for i in range(5)] == list(LEVELS)
    # The grades are the formulas of the text alone: they are the same in any company, and a text without stops is one long sentence.
    alone = {r.id: r.flesch_kincaid for r in reading_levels(quality(table.where("id = 900 OR id = 0")).withColumn("level", F.lit("A1"))).collect()}
    both = {r.id: (r.flesch_kincaid, r.words_per_sentence, r.sentence_words) for r in reading_levels(quality(table).join(table.select("id", "level"), "id")).collect()}
    assert alone[900] == both[900][0] and alone[0] == both[0][0] and both[900][1] > 3 * both[900][2]
    assert reading_levels(quality(table.limit(0)).withColumn("level", F.lit("A1"))).count() == 0


def test_links_and_prices_of_any_length():
    from lexmill.llm.spam import passages

    def marked(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return len(passages(data, np.array([0, len(data)]))["marked"])

    yes = ["see www.some-page.at now", "shop.somethingverylong/path/x", "name.com", "it is 12.50 eur", "eur 1234567,99 only", "€ 5,00", "12.999999999 usd", "http://a.b", "read this (de.some-page.xyz)", "(my-page.shop)", "one.two.three"]
    no = ["the end.then we went", "1.50 of them", "and/or", "(see 1.5)", "e.g.this", "3.5/4 points", "we got 12.50 and euro"]
    assert [marked(t) for t in yes] == [1] * len(yes) and [marked(t) for t in no] == [0] * len(no)


def test_spam_pages(spark):
    phrases = ["cheap shoes", "leather boots", "red sneakers"]
    dice = random.Random(1)
    rows = [(i, f"host{i}", " ".join(dice.choice(phrases) for k in range(60))) for i in range(5)]
    rows += [(20, "h", "\n".join(f"Where can I find {phrases[k % 3]} for me?" for k in range(30))), (21, "h", "\n".join(f'<a href="http://a{k}.test/x">All about the {k} things you need</a>' for k in range(20)))]
    rows += [(22, "w", " ".join(f"{a} {b} are what everybody wants." for a, b in zip(["Cheap shoes", "Leather boots", "Red sneakers"], ["and more", "of course", "now"])))]  # each once
    rows += [(36, "y", "word list " * 100_000), (37, "z", PROSE * 20_000)]
    rows += [(30, None, PROSE * 5), (31, None, PROSE * 5 + "\nhttp://one.test/a\nhttp://two.test/b\nTags: big, house"), (32, None, "I have a dog. I have a cat. I have a bird. " * 10), (33, None, None), (34, None, " "), (35, "x", "Red Boots - RB-1234 - 12,50 EUR - sale\n" * 9)]
    table = spark.createDataFrame([(i, h, t, 1) for i, h, t in rows], "doc_id long, author_key string, text string, words int")
    got = {r.doc_id: r.is_spam for r in spam_pages(table).collect()}
    assert got == {**dict.fromkeys(range(5), True), 20: True, 21: True, 22: True, 30: False, 31: False, 32: False, 34: False, 35: True, 36: True, 37: False}
    assert spam_pages(table.limit(0)).count() == 0
