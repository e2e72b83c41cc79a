"""Queries over the test tables, one for each operator, with their SQL where SQL can express them on whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import python_text, text as T
from lexmill.operators import accuracy, association, collocations, curation, density, feedback as fb, lexicon, models, mutation, ratings, repetition
from lexmill.operators import sophistication, statistics as st, substitution, taaled, variation
from lexmill.operators.annotate import annotate, annotate_sql
from lexmill.plans import sql as S
from lexmill.plans.pipeline import Pipeline
from lexmill.session import shared_folder, ship, spread, stored
from lexmill.sources import readers, sinks
from lexmill.streaming import stream

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(function):
        _QUERIES[function.__name__] = function
        if oracle is not None:
            _ORACLES[function.__name__] = oracle
        return function

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(rows: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return rows.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def tokens(spark: SparkSession, sf_dir: str, heads: bool = False) -> DataFrame:
    return annotate(docs(spark, sf_dir), heads=heads)


def grade(column: str) -> F.Column:
    n = T.typed_number(F.col(column))
    return F.when(n.between(0, 4), n)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, level, grade, FEATURES): records once each, by the small rows, so that no text is shuffled."""
    rows = table(spark, sf_dir, "flip_final")
    key = F.struct("id", T.level_name(F.col("level")).alias("level"), grade("vocab_grade_avg").alias("grade"))
    out = variation.variation_basic(rows.select(key.alias("k"), "essay"), "k", "essay")
    return out.select("k.*", *S.FEATURES).dropDuplicates(["id"])


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.long_features(features(spark, sf_dir).where("level IS NOT NULL"), list(S.FEATURES), ["id", "level", "grade"])


# Variation ---------------------------------------------------------------------------------------------------------


@query(f"WITH {S.DOCS}, c AS (SELECT doc_id, CAST(len(w) AS DOUBLE) AS n, CAST(len(list_distinct(w)) AS DOUBLE) AS t FROM docs), v AS (SELECT doc_id, n, t, {S.closed('n', 't')} FROM c) "
       f'SELECT doc_id, CAST(n AS BIGINT) AS "LV_W", CAST(t AS BIGINT) AS "LV_WT", {S.rounded("LV_TTR", "LV_CTTR", "LV_RTTR", "LV_DUGA", "LV_MAAS", "LV_SUMM")} FROM v')
def lv_basic(spark, sf_dir):
    return rounded(variation.variation_basic(docs(spark, sf_dir)), "LV_TTR", "LV_CTTR", "LV_RTTR", "LV_DUGA", "LV_MAAS", "LV_SUMM")


@query(f"""WITH {S.DOCS}, b AS (SELECT doc_id, x, count(*) AS f FROM (SELECT doc_id, unnest(w) AS x FROM docs) GROUP BY ALL),
s AS (SELECT doc_id, CAST(sum(f) AS DOUBLE) AS n FROM b GROUP BY doc_id),
h AS (SELECT b.doc_id, count(*) FILTER (f = 1) AS once, (sum(f * f) - max(n)) / pow(max(n), 2) AS y,
  CASE WHEN max(n) < 35 THEN 0 ELSE sum(1 - coalesce(list_aggregate(list_transform(range(35), lambda i: greatest(0.0, (n - f - i) / (n - i))), 'product'), 0)) / 35 END AS hdd
  FROM b JOIN s USING (doc_id) GROUP BY b.doc_id)
SELECT doc_id, coalesce(once, 0) AS "LV_WT1", round(coalesce(hdd, 0), 6) AS "LV_HDD", round(coalesce(y, 0), 6) AS "LV_YULEK" FROM docs LEFT JOIN h USING (doc_id)""")
def lv_frequency(spark, sf_dir):
    return rounded(variation.lexical_variation(docs(spark, sf_dir)).select("doc_id", "LV_WT1", "LV_HDD", "LV_YULEK"), "LV_HDD", "LV_YULEK")


@query(f"""WITH {S.DOCS} SELECT doc_id,
  round(CASE WHEN len(w) <= 25 THEN len(w) ELSE list_avg(list_transform(range(0, len(w) // 25), lambda i: len(list_distinct(w[i * 25 + 1:i * 25 + 25])) / 25.0)) END, 9) AS "LV_MSTTR",
  round(CASE WHEN len(w) <= 25 THEN len(w) ELSE list_avg(list_transform(range(1, len(w) - 23), lambda i: len(list_distinct(w[i:i + 24])) / 25.0)) END, 9) AS "LV_MATTR" FROM docs""")
def lv_windows(spark, sf_dir):
    return rounded(variation.lexical_variation(docs(spark, sf_dir)).select("doc_id", "LV_MSTTR", "LV_MATTR"), "LV_MSTTR", "LV_MATTR", digits=9)


def _pass(w: str) -> str:
    """SQL of one MTLD pass over a list of words: a fold that keeps the words of the open segment, its size and the segments closed."""
    start = "{'seen': CAST([] AS VARCHAR[]), 'size': 0, 'full': 0}"
    new = "CASE WHEN list_contains(a.seen, x.w) THEN a.seen ELSE list_append(a.seen, x.w) END"
    fold = f"""list_reduce(list_prepend({{'w': CAST(NULL AS VARCHAR), 'a': {start}}}, list_transform({w}, lambda x: {{'w': x, 'a': {start}}})), lambda p, x: {{'w': x.w, 'a': list_transform([p.a], lambda a:
      CASE WHEN len({new}) < 0.72 * (a.size + 1) THEN {{'seen': CAST([] AS VARCHAR[]), 'size': 0, 'full': a.full + 1}} ELSE {{'seen': {new}, 'size': a.size + 1, 'full': a.full}} END)[1]}}).a"""
    return fold


@query(f"""WITH {S.DOCS}, f AS (SELECT doc_id, len(w) AS n, {_pass('w')} AS a, {_pass('list_reverse(w)')} AS b FROM docs WHERE len(w) > 0),
g AS (SELECT doc_id, n, a.full + CASE WHEN a.size > 0 THEN (1 - len(a.seen) / a.size) / (1 - 0.72) ELSE 0 END AS a, b.full + CASE WHEN b.size > 0 THEN (1 - len(b.seen) / b.size) / (1 - 0.72) ELSE 0 END AS b FROM f)
SELECT doc_id, round(coalesce((n / CASE WHEN a > 0 THEN a ELSE 1 END + n / CASE WHEN b > 0 THEN b ELSE 1 END) / 2, 0), 6) AS "LV_MTLD" FROM docs LEFT JOIN g USING (doc_id)""")
def lv_mtld(spark, sf_dir):
    return rounded(variation.lexical_variation(docs(spark, sf_dir)).select("doc_id", "LV_MTLD"), "LV_MTLD")


# Annotation, density, content words --------------------------------------------------------------------------------


@query(f"WITH {S.TOKENS} SELECT * FROM tokens")
def annotated_tokens(spark, sf_dir):
    return tokens(spark, sf_dir)


@query(f"""WITH {S.TOKENS} SELECT doc_id, round(count(*) FILTER (upos IN ('NOUN', 'VERB', 'ADJ', 'ADV')) / count(*), 6) AS "LD_LXUR",
  round(count(*) FILTER (upos || ':' || tag IN ({", ".join(f"'{x}'" for x in density.GRAMMATICAL)})) / count(*), 6) AS "LD_GRUR" FROM tokens GROUP BY doc_id""")
def ld_ratios(spark, sf_dir):
    return rounded(density.lexical_density(tokens(spark, sf_dir)), "LD_LXUR", "LD_GRUR")


@query(f"""WITH {S.TOKENS} SELECT doc_id, count(*) AS tokens, count(*) FILTER (upos IN ('NOUN', 'VERB', 'ADJ', 'ADV')) AS lexical,
  count(*) FILTER (upos IN ('NOUN', 'VERB', 'ADJ', 'ADV') AND tag NOT IN ('NNP', 'NNPS', 'MD')) AS lexical_strict FROM tokens GROUP BY doc_id""")
def lexical_counts(spark, sf_dir):
    return density.token_counts(tokens(spark, sf_dir))


_CLASSIFIED = f"""{S.TOKENS}, reals AS (SELECT x AS word FROM (SELECT unnest({S.WORDS.format('text')}) AS x FROM documents) GROUP BY x HAVING count(*) >= 3),
adjs AS (SELECT DISTINCT lemma AS word FROM tokens WHERE tag = 'JJ'),
items AS (SELECT doc_id, sent_id, pos, CASE
  WHEN tag IN ('NN', 'NNS', 'NNP', 'NNPS') THEN lemma || '_cw_nn' WHEN tag IN ('JJ', 'JJR', 'JJS') THEN lemma || '_cw'
  WHEN tag IN ('VB', 'VBD', 'VBG', 'VBN', 'VBP', 'VBZ', 'MD') THEN lemma || CASE WHEN dep = 'aux' OR lemma = 'be' THEN '_fw' ELSE '_cw_vb' END
  WHEN tag IN ('RB', 'RBR', 'RBS') THEN lemma || CASE WHEN lemma LIKE '%ly' AND left(lemma, length(lemma) - 2) IN (SELECT word FROM adjs)
    OR lemma LIKE '%ally' AND left(lemma, length(lemma) - 4) IN (SELECT word FROM adjs) THEN '_cw' ELSE '_fw' END
  WHEN tag IN ('PRP', 'PRP$') THEN CASE lower WHEN 'me' THEN 'i' WHEN 'him' THEN 'he' WHEN 'her' THEN 'she' ELSE lower END || '_fw' ELSE lemma || '_fw' END AS item
  FROM tokens WHERE lower IN (SELECT word FROM reals) AND tag NOT IN ('.', ':', 'SYM')),
classified AS (SELECT doc_id, sent_id, pos, CASE WHEN item LIKE '%\\_fw' ESCAPE '\\' THEN 'function' ELSE 'content' END AS class, item FROM items)"""


def _classified(spark, sf_dir):
    t = stored(tokens(spark, sf_dir).select("doc_id", "sent_id", "pos", "lower", "lemma", "tag", "dep"))
    adjectives = t.where("tag = 'JJ'").select(F.col("lemma").alias("word")).distinct()
    return taaled.classify(t, adjectives, lexicon.dictionary(docs(spark, sf_dir)))


@query(f"WITH {_CLASSIFIED} SELECT * FROM classified")
def taaled_classes(spark, sf_dir):
    return _classified(spark, sf_dir)


@query(f"""WITH {_CLASSIFIED}, s AS (SELECT doc_id, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT item) AS DOUBLE) AS t, CAST(count(*) FILTER (class = 'content') AS DOUBLE) AS m,
  CAST(count(DISTINCT item) FILTER (class = 'content') AS DOUBLE) AS u, count(DISTINCT item) FILTER (class = 'function') AS f FROM classified GROUP BY doc_id)
SELECT doc_id, round(t / sqrt(n), 6) AS "TAALED_TTR_AW", round(CASE WHEN n > t THEN (log10(n) - log10(t)) / pow(log10(n), 2) ELSE 0 END, 6) AS "TAALED_MAAS_TTR_AW",
  round(CASE WHEN m > u THEN (log10(m) - log10(u)) / pow(log10(m), 2) ELSE 0 END, 6) AS "TAALED_MAAS_TTR_CW", CAST(m AS BIGINT) AS "TAALED_BASIC_NCONTENT_TOKENS", f AS "TAALED_BASIC_NFUNCTION_TYPES" FROM s""")
def taaled_basic(spark, sf_dir):
    return rounded(taaled.taaled_indices(_classified(spark, sf_dir), wrap=False), "TAALED_TTR_AW", "TAALED_MAAS_TTR_AW", "TAALED_MAAS_TTR_CW")


@query()
def taaled_wrap(spark, sf_dir):
    out = taaled.taaled_indices(_classified(spark, sf_dir))
    return rounded(out.select("doc_id", "TAALED_MTLD_MA_WRAP_AW", "TAALED_MTLD_MA_WRAP_CW"), "TAALED_MTLD_MA_WRAP_AW", "TAALED_MTLD_MA_WRAP_CW")


# Sophistication -----------------------------------------------------------------------------------------------------

_RANKED = f"""{S.TOKENS}, freqs AS (SELECT lemma AS word, tag, CAST(count(*) AS DOUBLE) AS freq FROM tokens WHERE NOT is_punct GROUP BY ALL),
ranked AS (SELECT CAST(row_number() OVER (ORDER BY freq DESC, word, tag) - 1 AS INTEGER) AS rank, word, tag, freq FROM freqs ORDER BY freq DESC, word, tag LIMIT 9000)"""


def _ranked(spark, sf_dir):
    """(tokens, ranked list), the tokens stored once for both."""
    t = stored(tokens(spark, sf_dir).select("doc_id", "lemma", "tag", "is_punct"))
    return t, stored(lexicon.ranked_list(t))


@query(f"WITH {_RANKED} SELECT * FROM ranked")
def ranked_lexicon(spark, sf_dir):
    return lexicon.ranked_list(tokens(spark, sf_dir))


_LISTS = {"NG": (0, 150), "NA": (150, 300), "TC": (300, 450), "BS": (450, 600)}
_PARTS = {"CA": (0, 9000), "CT": (0, 9000), "CGA1": (0, 3000), "CGA2": (3000, 6000), "CGA3": (6000, 9000)}


@query(f"""WITH {_RANKED}, bag AS (SELECT doc_id, lower(lemma) AS word, tag, count(*) AS f FROM tokens GROUP BY ALL),
{", ".join(f"l_{k} AS (SELECT DISTINCT word FROM ranked WHERE rank >= {a} AND rank < {b})" for k, (a, b) in _LISTS.items())},
{", ".join(f"r_{k} AS (SELECT word, tag, sum(freq) AS freq FROM ranked WHERE rank >= {a} AND rank < {b} AND {'rank % 2 = 0' if k == 'CA' else 'rank % 2 = 1' if k == 'CT' else 'TRUE'} GROUP BY ALL)" for k, (a, b) in _PARTS.items())},
g AS (SELECT doc_id, sum(f) AS n, {", ".join(f"count(DISTINCT l_{k}.word) AS m_{k}" for k in _LISTS)}, {", ".join(f"count(r_{k}.freq) AS m_{k}, sum(r_{k}.freq) AS s_{k}" for k in _PARTS)}
  FROM bag {" ".join(f"LEFT JOIN l_{k} ON l_{k}.word = bag.word" for k in _LISTS)} {" ".join(f"LEFT JOIN r_{k} ON r_{k}.word = bag.word AND r_{k}.tag = bag.tag" for k in _PARTS)} GROUP BY doc_id)
SELECT doc_id, {", ".join(f'round(m_{k} / n, 6) AS "LS_FPC_{k}"' for k in [*_LISTS, *_PARTS])}, {", ".join(f'round(coalesce(s_{k} / nullif(m_{k}, 0), 0), 6) AS "{m}"' for m, k in zip(sophistication.MEANS, _PARTS))} FROM g""")
def ls_coverage(spark, sf_dir):
    t, r = _ranked(spark, sf_dir)
    lists = {k: lexicon.word_list(r, *b) for k, b in _LISTS.items()}
    out = sophistication.lexical_sophistication(t, lists, {"CA": r.where("rank % 2 = 0"), "CT": r.where("rank % 2 = 1"), "CG": r})
    return rounded(out, *out.columns[1:])


_MATCHED = _LISTS | _PARTS


@query(f"WITH {_RANKED} " + " UNION ALL ".join(
    f"SELECT '{k}' AS list, doc_id, list_sort(list(DISTINCT lower(lemma))) AS words FROM tokens WHERE lower(lemma) IN "
    f"(SELECT word FROM ranked WHERE rank >= {a} AND rank < {b} AND {'rank % 2 = 0' if k == 'CA' else 'rank % 2 = 1' if k == 'CT' else 'TRUE'}) GROUP BY doc_id"
    for k, (a, b) in _MATCHED.items()
))
def ls_matched_words(spark, sf_dir):
    """Of each of the nine lists."""
    t, r = _ranked(spark, sf_dir)
    lists = {k: lexicon.word_list({"CA": r.where("rank % 2 = 0"), "CT": r.where("rank % 2 = 1")}.get(k, r), *b) for k, b in _MATCHED.items()}
    return sophistication.matched_words(t, lists)


@query(f"""WITH {S.TOKENS} SELECT doc_id, round(avg(length(lemma)), 6) AS "LD_AVG_CH", round(avg(greatest(len(regexp_extract_all(lower(lemma), '[aeiouy]+')), 1)), 6) AS "LD_NUM_SYLL"
FROM tokens WHERE NOT is_punct GROUP BY doc_id""")
def word_shape(spark, sf_dir):
    return rounded(sophistication.word_shape(tokens(spark, sf_dir)), "LD_AVG_CH", "LD_NUM_SYLL")


# Accuracy -----------------------------------------------------------------------------------------------------------

_DICT = f"dict AS (SELECT x AS word, count(*) AS freq FROM (SELECT unnest({S.WORDS.format('text')}) AS x FROM documents) GROUP BY x HAVING count(*) >= 20)"


def _dictionary(spark, sf_dir):
    return lexicon.dictionary(docs(spark, sf_dir), least=20)


@query(f"""WITH {S.TOKENS}, {_DICT} SELECT doc_id, sent_id, pos, lower FROM tokens WHERE ent_type = '' AND regexp_matches(text, '^[A-Za-z]+$') AND lower NOT IN (SELECT word FROM dict)""")
def spelling_errors(spark, sf_dir):
    return accuracy.spelling_errors(tokens(spark, sf_dir), _dictionary(spark, sf_dir)).select("doc_id", "sent_id", "pos", "lower")


@query(f"""WITH {S.TOKENS}, {_DICT}, e AS (SELECT doc_id, count(*) AS n, count(*) FILTER (ent_type = '' AND regexp_matches(text, '^[A-Za-z]+$') AND lower NOT IN (SELECT word FROM dict)) AS e FROM tokens GROUP BY doc_id)
SELECT doc_id, e AS "LA_E", round(e / n, 6) AS "LA_ER" FROM e""")
def lexical_accuracy(spark, sf_dir):
    return rounded(accuracy.lexical_accuracy(tokens(spark, sf_dir), _dictionary(spark, sf_dir)), "LA_ER")


def _away(a: str, b: str) -> str:
    """SQL of the distance in letters: DuckDB counts bytes, so letters beyond ASCII become digits and capitals first, which no lower-cased word holds."""
    plain = lambda x: f"translate({x}, 'äöüßéèêáàâóòôúùûíìîç', '0123456789ABCDEFGHIJ')"
    return f"damerau_levenshtein({plain(a)}, {plain(b)})"


def _best(spark, sf_dir):
    found = docs(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    found = stored(found)
    return accuracy.corrections(found.where("freq < 20"), found.where("freq >= 20"))


_BEST = f"""all_ AS (SELECT x AS word, count(*) AS freq FROM (SELECT unnest({S.WORDS.format('text')}) AS x FROM documents) GROUP BY x),
p AS (SELECT a.word, b.word AS best, b.freq, {_away('a.word', 'b.word')} AS d FROM all_ a JOIN all_ b ON a.freq < 20 AND b.freq >= 20 AND abs(length(a.word) - length(b.word)) <= 2),
best AS (SELECT word, best FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, freq DESC, best) AS rn FROM p WHERE d <= 2) WHERE rn = 1)"""


@query(f"WITH {_BEST} SELECT word, best FROM best")
def spelling_corrections(spark, sf_dir):
    return _best(spark, sf_dir)


@query(f"""WITH {_BEST}, w AS (SELECT doc_id, i, w[i] AS w FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)))
SELECT doc_id, string_agg(coalesce(best, w), ' ' ORDER BY i) || ' ' AS text FROM w LEFT JOIN best ON word = w GROUP BY doc_id""")
def corrected_texts(spark, sf_dir):
    return accuracy.correct_spelling(docs(spark, sf_dir), _best(spark, sf_dir))


def _contracted() -> str:
    """SQL that replaces one contraction after the other, those with a capital I only as written."""
    out = "replace(text, '´', '''')"
    for short, full in python_text.CONTRACTIONS.items():
        key = short.replace("'", "''")
        if short != short.lower():
            out = f"regexp_replace(replace({out}, '{key}', '{full}'), '{key}', '', 'gi')"
        else:
            out = f"regexp_replace({out}, '{key}', '{full}', 'gi')"
    return f"replace({out}, '''', '')"


# Collocations --------------------------------------------------------------------------------------------------------

_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(str(tuple(x if x is not None else "" for x in r)) for r in collocations.pattern_rules()) + ") AS v(ord, type, head_tag, dep, tag, head_class, class))"
_FOUND = f"""{S.TOKENS}, {_RULES}, deps AS (
  SELECT t.doc_id, t.sent_id, t.pos, h.text AS head_text, h.lemma AS head_lemma, h.tag AS head_tag, t.dep, t.text, t.lemma, t.tag
  FROM tokens t JOIN tokens h ON h.doc_id = t.doc_id AND h.sent_id = t.sent_id AND h.pos = t.head_pos
), found AS (
  SELECT doc_id, sent_id, pos, ord, lemma || coalesce('_' || nullif(class, ''), '') AS lempos1, head_lemma || coalesce('_' || nullif(head_class, ''), '') AS lempos2, type
  FROM deps JOIN rules USING (head_tag, dep, tag)
  WHERE head_lemma NOT IN {collocations.STOPWORDS} AND lemma NOT IN {collocations.STOPWORDS} AND head_lemma <> lemma
)"""
_EDGES = f"""{_FOUND}, pairs AS (SELECT lempos1, lempos2, type, count(*) AS raw_freq FROM found GROUP BY ALL),
edges AS (SELECT lempos1, lempos2, type, raw_freq, ln(raw_freq * n / (r * c)) AS metric FROM (SELECT *, CAST(sum(raw_freq) OVER (PARTITION BY lempos1, type) AS DOUBLE) AS r,
  CAST(sum(raw_freq) OVER (PARTITION BY lempos2, type) AS DOUBLE) AS c, CAST(sum(raw_freq) OVER (PARTITION BY type) AS DOUBLE) AS n FROM pairs) WHERE raw_freq >= 2)"""


def _found(spark, sf_dir):
    return stored(collocations.collocations(tokens(spark, sf_dir, heads=True)))


def _preprocessed(spark, sf_dir):
    """Collocations of the preprocessed texts, as the pipeline looks for them; _found is held to its SQL, which takes the raw tokens."""
    texts = docs(spark, sf_dir)
    return stored(collocations.collocations(annotate(accuracy.preprocessed(texts, stored(lexicon.dictionary(texts))), heads=True)))


@query(f"WITH {_FOUND} SELECT * FROM deps")
def dependencies(spark, sf_dir):
    return collocations.dependencies(tokens(spark, sf_dir, heads=True))


@query(f"WITH {_FOUND} SELECT * FROM found")
def collocation_match(spark, sf_dir):
    return collocations.collocations(tokens(spark, sf_dir, heads=True))


#: Contractions expanded, then words outside the dictionary replaced by their correction; tokens of that.
_PREPROCESSED = f"""expanded AS (SELECT doc_id, {_contracted()} AS text FROM documents),
uses AS (SELECT x AS word, count(*) AS freq FROM (SELECT unnest({S.WORDS.format('text')}) AS x FROM expanded) GROUP BY x),
known AS (SELECT x AS word FROM (SELECT unnest({S.WORDS.format('text')}) AS x FROM documents) GROUP BY x HAVING count(*) >= 3),
close AS (SELECT a.word, b.word AS best, coalesce(u.freq, 0) AS freq, {_away('a.word', 'b.word')} AS d FROM uses a ANTI JOIN known k ON k.word = a.word JOIN known b ON abs(length(a.word) - length(b.word)) <= 2 LEFT JOIN uses u ON u.word = b.word),
best AS (SELECT word, best FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, freq DESC, best) AS rn FROM close WHERE d <= 2) WHERE rn = 1),
runs AS (SELECT doc_id, i, r[i] AS r FROM (SELECT doc_id, r, unnest(range(1, len(r) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\\p{{L}}+|\\P{{L}}+') AS r FROM expanded))),
plain AS (SELECT doc_id, string_agg(CASE WHEN best IS NULL THEN r WHEN left(r, 1) = lower(left(r, 1)) THEN best ELSE upper(left(best, 1)) || substr(best, 2) END, '' ORDER BY i) AS text FROM runs LEFT JOIN best ON word = lower(r) GROUP BY doc_id),
{annotate_sql("plain")}"""


def _on_plain(oracle: str) -> str:
    """The SQL of a query over the raw texts, over the preprocessed ones."""
    return oracle.replace(S.TOKENS, _PREPROCESSED)


@query(_on_plain(_ORACLES["collocation_match"]))
def collocation_match_preprocessed(spark, sf_dir):
    return _preprocessed(spark, sf_dir)


@query(f"WITH {_EDGES} SELECT lempos1, lempos2, type, round(metric, 6) AS metric, raw_freq FROM edges")
def collocation_edges(spark, sf_dir):
    return rounded(collocations.edge_table(_found(spark, sf_dir)), "metric")


@query(f"WITH {_EDGES} SELECT f.doc_id, f.sent_id, f.pos, f.ord, f.lempos1, f.lempos2, f.type, round(metric, 6) AS metric FROM found f LEFT JOIN edges e USING (lempos1, lempos2, type)")
def collocation_metric(spark, sf_dir):
    found = _found(spark, sf_dir)
    out = collocations.with_metric(found, collocations.edge_table(found))
    return rounded(out, "metric").select("doc_id", "sent_id", "pos", "ord", "lempos1", "lempos2", "type", "metric")


@query(f"""WITH {_EDGES}, m AS (SELECT f.doc_id, e.metric FROM found f LEFT JOIN edges e USING (lempos1, lempos2, type)),
g AS (SELECT doc_id, count(*) AS n, count(metric) AS k, count(*) FILTER (metric < 1.064) AS "CA_BIN1", count(*) FILTER (metric >= 1.064 AND metric < 1.64) AS "CA_BIN2", count(*) FILTER (metric >= 1.64) AS "CA_BIN3" FROM m GROUP BY doc_id)
SELECT doc_id, round((n - k) / n, 6) AS "LA_COL_ERR_R", "CA_BIN1", "CA_BIN2", "CA_BIN3", {", ".join(f'round(coalesce("CA_BIN{i}" / nullif(k, 0), 0), 6) AS "CA_BIN{i}_R"' for i in (1, 2, 3))} FROM g""")
def collocation_indices(spark, sf_dir):
    return _indices(_found(spark, sf_dir))


@query(_on_plain(_ORACLES["collocation_indices"]))
def collocation_indices_preprocessed(spark, sf_dir):
    return _indices(_preprocessed(spark, sf_dir))


def _indices(found: DataFrame) -> DataFrame:
    out = collocations.collocation_indices(collocations.with_metric(found, collocations.edge_table(found)))
    return rounded(out, "LA_COL_ERR_R", "CA_BIN1_R", "CA_BIN2_R", "CA_BIN3_R")


@query(f"WITH {_EDGES} SELECT doc_id, count(*) AS n, count(DISTINCT lempos1 || ' ' || lempos2 || coalesce(CAST(round(metric, 2) AS VARCHAR), 'X')) AS renderings FROM found LEFT JOIN edges USING (lempos1, lempos2, type) GROUP BY doc_id")
def collocation_rendering(spark, sf_dir):
    found = _found(spark, sf_dir)
    out = collocations.with_metric(found, collocations.edge_table(found))
    return out.select("doc_id", collocations.rendered(out).alias("r")).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("r").alias("renderings"))


_SCORES = f"""{_EDGES}, d AS (SELECT DISTINCT doc_id, lempos1, lempos2, type FROM found), o AS (
  SELECT d.*, coalesce(p.f, 0.0) + 1e-33 AS o11, coalesce(r.f, 0.0) - coalesce(p.f, 0.0) + 1e-33 AS o12, coalesce(c.f, 0.0) - coalesce(p.f, 0.0) + 1e-33 AS o21, t.f - coalesce(p.f, 0.0) + 1e-33 AS o22
  FROM d LEFT JOIN (SELECT lempos1, lempos2, CAST(sum(raw_freq) AS DOUBLE) AS f FROM edges GROUP BY ALL) p USING (lempos1, lempos2)
  LEFT JOIN (SELECT lempos1, CAST(sum(raw_freq) AS DOUBLE) AS f FROM edges GROUP BY ALL) r USING (lempos1) LEFT JOIN (SELECT lempos2, CAST(sum(raw_freq) AS DOUBLE) AS f FROM edges GROUP BY ALL) c USING (lempos2)
  CROSS JOIN (SELECT CAST(sum(raw_freq) AS DOUBLE) AS f FROM edges) t
), e AS (SELECT *, (o11 + o12) * (o11 + o21) / (o11 + o12 + o21 + o22) AS e11, (o11 + o12) * (o12 + o22) / (o11 + o12 + o21 + o22) AS e12,
  (o21 + o22) * (o11 + o21) / (o11 + o12 + o21 + o22) AS e21, (o21 + o22) * (o12 + o22) / (o11 + o12 + o21 + o22) AS e22 FROM o
), scores AS (SELECT doc_id, lempos1, lempos2, type, o11, ln(o11 / e11) AS mi, 3 * ln(o11) - ln(e11) AS mi3, (o11 - e11) / sqrt(o11) AS t, (o11 - e11) / sqrt(e11) AS z,
  pow(o11 - e11, 2) / e11 + pow(o12 - e12, 2) / e12 + pow(o21 - e21, 2) / e21 + pow(o22 - e22, 2) / e22 AS chi2 FROM e)"""


def _scores(found: DataFrame) -> DataFrame:
    return association.scored(found, stored(collocations.edge_table(found)))


@query(f"WITH {_SCORES} SELECT doc_id, lempos1, lempos2, type, round(o11, 3) AS o11, round(mi, 3) AS mi, round(mi3, 3) AS mi3 FROM scores")
def association_scores(spark, sf_dir):
    return rounded(_scores(_found(spark, sf_dir)), "o11", "mi", "mi3", digits=3).select("doc_id", "lempos1", "lempos2", "type", "o11", "mi", "mi3")


#: For pairs without an edge t and chi2 run to numbers of thirty digits: compared to six significant ones.
_SIX = "CAST(printf('%.5e', {}) AS DOUBLE)"


def six_digits(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.when(F.col(n).isNotNull(), F.format_string("%.5e", F.col(n)).cast("double")) for n in names})


@query(f"""WITH {_SCORES} SELECT doc_id, {", ".join(f"{_SIX.format(f'{f}({m})')} AS {m}_{n}" for m in association.MEASURES for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")))} FROM scores GROUP BY doc_id""")
def association_indices(spark, sf_dir):
    out = association.association_indices(_scores(_found(spark, sf_dir)))
    return six_digits(out, *out.columns[1:])


_G2 = " + ".join(f"CASE WHEN o{i}{j} > 1e-9 THEN o{i}{j} * ln(o{i}{j} / (r{i} * c{j} / n)) ELSE 0 END" for i in (1, 2) for j in (1, 2))


@query(f"""WITH {_EDGES}, m AS (SELECT lempos1, lempos2, type, CAST(sum(raw_freq) OVER (PARTITION BY lempos1, lempos2) AS DOUBLE) AS o11, CAST(sum(raw_freq) OVER (PARTITION BY lempos1) AS DOUBLE) AS r1,
  CAST(sum(raw_freq) OVER (PARTITION BY lempos2) AS DOUBLE) AS c1, CAST(sum(raw_freq) OVER () AS DOUBLE) AS n FROM edges),
o AS (SELECT *, r1 - o11 AS o12, c1 - o11 AS o21, n - r1 - c1 + o11 AS o22, n - r1 AS r2, n - c1 AS c2 FROM m)
SELECT lempos1, lempos2, type, round(2 * ({_G2}), 4) AS g2 FROM o""")
def log_likelihoods(spark, sf_dir):
    """G2 of every edge."""
    edges = stored(collocations.edge_table(_found(spark, sf_dir)))
    pairs = edges.select(F.lit(0).alias("doc_id"), "lempos1", "lempos2", "type")
    return rounded(association.log_likelihood(pairs, edges).drop("doc_id"), "g2", digits=4)


@query(_on_plain(_ORACLES["association_indices"]))
def association_all(spark, sf_dir):
    """Of all pairs, in the preprocessed texts."""
    out = association.association_indices(_scores(_preprocessed(spark, sf_dir)))
    return six_digits(out, *out.columns[1:])


# Repetition ----------------------------------------------------------------------------------------------------------

_FLAGGED = f"""{S.TOKENS}, flagged AS (SELECT *, NOT is_stop AND NOT in_coref AND NOT is_punct AND count(*) FILTER (NOT is_stop AND NOT in_coref) OVER (PARTITION BY doc_id, lower(lemma)) > 1 AS is_repetition FROM tokens)"""


@query(f"WITH {_FLAGGED} SELECT doc_id, sent_id, pos, is_repetition FROM flagged")
def repetition_flags(spark, sf_dir):
    return repetition.repetitions(tokens(spark, sf_dir)).select("doc_id", "sent_id", "pos", "is_repetition")


@query(f"""WITH {_FLAGGED}, d AS (SELECT doc_id, count(*) FILTER (is_repetition) AS r, count(DISTINCT lower(lemma)) FILTER (is_repetition) AS w FROM flagged GROUP BY doc_id),
s AS (SELECT doc_id, sent_id, count(*) FILTER (is_repetition) AS r, count(DISTINCT lower(lemma)) FILTER (is_repetition) AS w FROM flagged GROUP BY doc_id, sent_id),
v AS (SELECT 'essay' AS scope, r AS v FROM d UNION ALL SELECT 'essay_words', w FROM d UNION ALL SELECT 'sentence', r FROM s WHERE r > 0 UNION ALL SELECT 'sentence_words', w FROM s)
SELECT scope, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, CAST(median(v) AS DOUBLE) AS median, round(100.0 * count(*) FILTER (v = 0) / count(*), 6) AS zeros_percent FROM v GROUP BY scope""")
def repetition_stats(spark, sf_dir):
    return rounded(repetition.repetition_statistics(tokens(spark, sf_dir)), "mean", "zeros_percent")


@query(f"""WITH {S.TOKENS} SELECT doc_id, lower(lemma) AS lemma, count(*) AS n FROM tokens WHERE upos IN ('NOUN', 'VERB', 'ADJ', 'ADV') AND NOT in_coref GROUP BY ALL HAVING count(*) > 1""")
def substitution_candidates(spark, sf_dir):
    return repetition.substitution_candidates(tokens(spark, sf_dir))


# Thresholds and feedback ----------------------------------------------------------------------------------------------

_SAMPLE = f"{S.LONG}, known AS (SELECT level, feature, avg(value) AS mean, stddev_samp(value) AS std FROM long GROUP BY ALL)"
_POPULATION = _SAMPLE.replace("stddev_samp", "stddev_pop")
# Values are compared with rounded bounds on both sides, as sums of doubles differ in their last digits by order.
_GIVEN = ", given AS (SELECT level, feature, round(mean, 6) AS mean, round(std, 6) AS std FROM known WHERE std IS NOT NULL)"


def _known(spark, sf_dir, population=False):
    return fb.thresholds(long(spark, sf_dir), ["level"], population)


@query(f"WITH {_SAMPLE} SELECT level, feature, round(mean, 6) AS mean, round(std, 6) AS std FROM known")
def thresholds_sample(spark, sf_dir):
    return rounded(_known(spark, sf_dir), "mean", "std")


@query(f"WITH {_POPULATION} SELECT level, feature, round(mean, 6) AS mean, round(std, 6) AS std FROM known")
def thresholds_population(spark, sf_dir):
    return rounded(_known(spark, sf_dir, True), "mean", "std")


def _given(spark, sf_dir, population=False):
    return stored(rounded(_known(spark, sf_dir, population), "mean", "std").where("std IS NOT NULL"))


@query(f"""WITH {_SAMPLE}{_GIVEN} SELECT id, level, feature, CASE WHEN round(value, 6) <= mean - std THEN 'positive' WHEN round(value, 6) >= mean + std THEN 'negative' ELSE 'none' END AS feedback FROM long JOIN given USING (level, feature)""")
def feedback_labels(spark, sf_dir):
    rows = rounded(long(spark, sf_dir), "value")
    return fb.feedback(rows, _given(spark, sf_dir), ["level"]).select("id", "level", "feature", "feedback")


@query(f"""WITH {_POPULATION}{_GIVEN} SELECT id, level, feature, CASE WHEN mean = 0 AND std = 0 THEN 0 WHEN round(value, 6) >= mean + std THEN 1 WHEN round(value, 6) <= mean - std THEN -1 ELSE 0 END AS code FROM long JOIN given USING (level, feature)""")
def feedback_codes(spark, sf_dir):
    rows = rounded(long(spark, sf_dir), "value")
    return fb.feedback(rows, _given(spark, sf_dir, True), ["level"]).select("id", "level", "feature", "code")


@query(f"""WITH {_POPULATION}{_GIVEN} SELECT id, level, feature, CASE WHEN round(value, 6) >= mean + std THEN 1 WHEN round(value, 6) <= mean - std THEN -1 ELSE 0 END AS code FROM long JOIN given USING (level, feature)""")
def feedback_codes_unguarded(spark, sf_dir):
    """The older evaluator."""
    rows = rounded(long(spark, sf_dir), "value")
    return fb.feedback(rows, _given(spark, sf_dir, True), ["level"], guard=False).select("id", "level", "feature", "code")


@query(f"""WITH {_POPULATION}{_GIVEN}, v AS (SELECT level, feature, round(value, 6) AS v, mean AS m, std AS s FROM long JOIN given USING (level, feature))
SELECT level, feature, count(*) FILTER (v < m - s) AS bin1, count(*) FILTER (v >= m - s AND v < m) AS bin2, count(*) FILTER (v >= m AND v < m + s) AS bin3, count(*) FILTER (v >= m + s) AS bin4 FROM v GROUP BY ALL""")
def bin_occupancy(spark, sf_dir):
    return fb.occupancy(rounded(long(spark, sf_dir), "value"), _given(spark, sf_dir, True), ["level"])


@query(f"""WITH {_SAMPLE} SELECT level, feature, round(mean, 4) AS mean, round(std, 4) AS std, round(mean - std, 4) AS low, round(mean + std, 4) AS high FROM known""")
def threshold_table(spark, sf_dir):
    return fb.threshold_table(_known(spark, sf_dir))


@query(f"""WITH {_SAMPLE}, l AS (SELECT feature, level || ' ' || printf('%.4f', mean) || ' ' || printf('%.4f', std) || ' ' || printf('%.4f', mean - std) || ' ' || printf('%.4f', mean + std) AS line FROM known WHERE std IS NOT NULL)
SELECT feature, string_agg(line, chr(10) ORDER BY line) AS summary FROM l GROUP BY feature""")
def threshold_summary(spark, sf_dir):
    return sinks.threshold_summary(_known(spark, sf_dir).where("std IS NOT NULL"))


@query(f"""WITH {_SAMPLE}{_GIVEN}, f AS (SELECT level, feature, CASE WHEN round(value, 6) <= mean - std THEN 'positive' WHEN round(value, 6) >= mean + std THEN 'negative' ELSE 'none' END AS feedback FROM long JOIN given USING (level, feature))
SELECT level, feature, feedback, count(*) AS n FROM f GROUP BY ALL""")
def flagship(spark, sf_dir):
    """Thresholds of the lexical indices by level, and the feedback they give, counted."""
    rows = rounded(long(spark, sf_dir), "value")
    return fb.feedback(rows, _given(spark, sf_dir), ["level"]).groupBy("level", "feature", "feedback").agg(F.count("*").alias("n"))


# Statistics -----------------------------------------------------------------------------------------------------------


@query(f"WITH {S.DOCS} SELECT len(w) AS n_words, count(*) AS n FROM docs GROUP BY ALL")
def token_histogram(spark, sf_dir):
    return st.frequency_table(variation.variation_basic(docs(spark, sf_dir)).select(F.col("LV_W").alias("n_words")), "n_words")


@query(f"WITH {S.RECORDS} SELECT grade, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM records GROUP BY grade")
def score_distribution(spark, sf_dir):
    rows = table(spark, sf_dir, "flip_final").select("id", grade("vocab_grade_avg").alias("grade")).dropDuplicates(["id"])
    return rounded(st.distribution(rows, "grade"), "percent")


_OVERALL = f"SELECT DISTINCT id, CAST(g AS BIGINT) * 5 AS score, n FROM (SELECT id, {S.number('overall_grade_1st')} AS g, len(coalesce({S.WORDS.format('essay')}, [])) AS n FROM flip_final) WHERE g BETWEEN 0 AND 20 AND g = floor(g)"


@query(f"WITH s AS ({_OVERALL}) SELECT i AS score, round(coalesce(avg(n), 0), 6) AS average FROM (SELECT unnest(range(1, 101)) AS i) LEFT JOIN s ON s.score = i GROUP BY i")
def avg_tokens_per_score(spark, sf_dir):
    n = T.typed_number(F.col("overall_grade_1st"))
    rows = table(spark, sf_dir, "flip_final").select("id", (n.cast("long") * 5).alias("score"), F.coalesce(F.size(T.words(F.col("essay"))), F.lit(0)).alias("n"), n.alias("g"))
    rows = rows.where("g BETWEEN 0 AND 20 AND g = floor(g)").dropDuplicates(["id"])
    return rounded(st.average_per_score(rows, "score", "n"), "average")


_BANDS = ("A1", "A2", "B1", "B2", "C1")


@query(f"""WITH {S.RECORDS} SELECT grade, {", ".join(f"count(*) FILTER (left(level, 2) = '{b}') AS \"{b}\"" for b in _BANDS)} FROM records WHERE grade IS NOT NULL AND level IS NOT NULL GROUP BY grade""")
def grade_by_level(spark, sf_dir):
    rows = table(spark, sf_dir, "flip_final").select("id", grade("vocab_grade_avg").alias("grade"), curation.level_band(T.level_name(F.col("level"))).alias("band"))
    return st.cross_tab(rows.dropDuplicates(["id"]).where("grade IS NOT NULL AND band IS NOT NULL"), "grade", "band", list(_BANDS))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, [" + ", ".join(f"{i / 100}" for i in range(100)) + "]) AS v FROM orders) SELECT CAST(i AS INTEGER) AS p, round(v[i + 1], 6) AS value FROM (SELECT v, unnest(range(0, 100)) AS i FROM q)")
def percentiles(spark, sf_dir):
    return rounded(st.percentiles(table(spark, sf_dir, "orders"), "o_totalprice"), "value")


@query(f"""WITH {S.FEATURED} SELECT level, count("LV_W") AS n, round(avg("LV_W"), 6) AS mean, round(stddev_pop("LV_W"), 6) AS std, min("LV_W") AS min, max("LV_W") AS max, median("LV_W") AS median FROM featured WHERE level IS NOT NULL GROUP BY level""")
def describe_by_level(spark, sf_dir):
    rows = features(spark, sf_dir).where("level IS NOT NULL").withColumn("LV_W", F.col("LV_W").cast("double"))
    return rounded(st.describe(rows, "LV_W", ["level"]), "mean", "std")


@query("""SELECT source, level, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, min(n_chars) AS min, max(n_chars) AS max FROM (SELECT source, coalesce(level, '-') AS level, n_chars FROM documents) GROUP BY ROLLUP (source, level)""")
def described_totals(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("level", F.coalesce("level", F.lit("-")))
    return rounded(st.described_totals(rows, "n_chars", ["source", "level"]), "mean")


@query("SELECT dimension, rater, round(avg(score), 6) AS mean FROM (SELECT DISTINCT rating_id, dimension, rater, score FROM ratings) GROUP BY ALL")
def mean_by_rater(spark, sf_dir):
    return rounded(ratings.newest(table(spark, sf_dir, "ratings")).groupBy("dimension", "rater").agg(F.avg("score").alias("mean")), "mean")


@query(f"WITH {S.LONG} SELECT level, feature, round(corr(value, grade), 6) AS r FROM long WHERE grade IS NOT NULL GROUP BY ALL")
def pearson_features(spark, sf_dir):
    return rounded(st.pearson(long(spark, sf_dir).where("grade IS NOT NULL"), "grade", ["level"]), "r")


@query(f"""WITH {S.FEATURED}, k AS (SELECT left(level, 2) AS band, "LV_W" AS a, grade AS b FROM featured WHERE level IS NOT NULL AND grade IS NOT NULL),
r AS (SELECT band, rank() OVER (PARTITION BY band ORDER BY a) + (count(*) OVER (PARTITION BY band, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY band ORDER BY b) + (count(*) OVER (PARTITION BY band, b) - 1) / 2.0 AS rb FROM k)
SELECT band, round(corr(ra, rb), 6) AS rho FROM r GROUP BY band""")
def spearman_by_band(spark, sf_dir):
    rows = features(spark, sf_dir).where("level IS NOT NULL").select(curation.level_band(F.col("level")).alias("band"), "LV_W", "grade")
    return rounded(st.spearman(rows, "LV_W", "grade", ["band"]), "rho")


@query(f"""WITH {S.FEATURED} SELECT level, round(regr_slope("LV_WT", "LV_W"), 6) AS slope, round(regr_intercept("LV_WT", "LV_W"), 6) AS intercept, round(regr_r2("LV_WT", "LV_W"), 6) AS r2 FROM featured WHERE level IS NOT NULL GROUP BY level""")
def linear_fit(spark, sf_dir):
    return rounded(st.linear_fit(features(spark, sf_dir).where("level IS NOT NULL"), "LV_WT", "LV_W", ["level"]), "slope", "intercept", "r2")


_PAIRS = [(a, b) for i, a in enumerate(S.FEATURES) for b in S.FEATURES[i + 1 :]]


@query(f"WITH {S.FEATURED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(\"{a}\", \"{b}\"), 6) AS r FROM featured" for a, b in _PAIRS))
def correlation_matrix(spark, sf_dir):
    return rounded(st.correlation_matrix(features(spark, sf_dir), list(S.FEATURES)), "r")


@query(f"WITH {S.LONG}, c AS (SELECT feature, round(corr(value, grade), 6) AS r FROM long WHERE grade IS NOT NULL GROUP BY feature) SELECT * FROM c ORDER BY abs(r) DESC, feature LIMIT 5")
def strongest_features(spark, sf_dir):
    return st.strongest(rounded(st.pearson(long(spark, sf_dir).where("grade IS NOT NULL"), "grade"), "r"), 5)


@query("""WITH b AS (SELECT least(floor((l_extendedprice - 900) / ((105000 - 900) / 50.0)) + 1, 50) AS x, least(floor((l_quantity - 1) / ((50 - 1) / 10.0)) + 1, 10) AS y FROM lineitem WHERE l_extendedprice BETWEEN 900 AND 105000 AND l_quantity BETWEEN 1 AND 50)
SELECT CAST(x AS INTEGER) AS x_bin, CAST(y AS INTEGER) AS y_bin, count(*) AS n FROM b GROUP BY ALL""")
def histogram_2d(spark, sf_dir):
    return st.histogram_2d(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", (900, 105000), (1, 50))


@query(f"""WITH {S.TOKENS}, d AS (SELECT doc_id, count(*) FILTER (NOT is_punct) AS w, count(DISTINCT sent_id) AS s FROM tokens GROUP BY doc_id) SELECT count(*) AS n, round(avg(w), 6) AS words, round(avg(s), 6) AS sentences FROM d""")
def holistic_averages(spark, sf_dir):
    return rounded(st.holistic_averages(tokens(spark, sf_dir)), "words", "sentences")


@query(f"WITH {S.TOKENS}, s AS (SELECT count(*) AS tokens FROM tokens GROUP BY doc_id, sent_id) SELECT tokens, count(*) AS n FROM s GROUP BY tokens")
def sentence_lengths(spark, sf_dir):
    return st.sentence_lengths(tokens(spark, sf_dir))


@query("SELECT source, count(*) AS n, arg_min(doc_id, n_chars * 1000000000 + doc_id) AS example FROM documents GROUP BY source")
def first_examples(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("_o", F.col("n_chars") * 1_000_000_000 + F.col("doc_id"))
    return st.first_example(rows, "source", "doc_id", "_o")


# Ratings ----------------------------------------------------------------------------------------------------------------

_DIMENSIONS = ("content", "organiz", "vocab", "grammar", "mechanics")
_CLEAN = "clean AS (SELECT DISTINCT rating_id, target_id, rater, dimension, score FROM ratings)"
_RPAIRS = f"{_CLEAN}, pairs AS (SELECT x.target_id, x.dimension, x.rater AS rater_a, y.rater AS rater_b, x.score AS a, y.score AS b FROM clean x JOIN clean y ON x.target_id = y.target_id AND x.dimension = y.dimension AND x.rater < y.rater WHERE x.score IS NOT NULL AND y.score IS NOT NULL)"


def _pairs(spark, sf_dir):
    return ratings.rater_pairs(ratings.newest(table(spark, sf_dir, "ratings")))


@query("SELECT DISTINCT target_id, rater, dimension, score FROM (" + " UNION ALL ".join(f"SELECT id AS target_id, graded_by_{n} AS rater, '{d}' AS dimension, {d}_grade_{n} AS score FROM flip_final" for d in _DIMENSIONS for n in ("1st", "2nd")) + ") WHERE length(rater) >= 2")
def long_ratings(spark, sf_dir):
    return ratings.long_ratings(table(spark, sf_dir, "flip_final"), "id", list(_DIMENSIONS)).distinct()


@query("SELECT rating_id, arg_max(target_id, loaded_at) AS target_id, arg_max(rater, loaded_at) AS rater, arg_max(dimension, loaded_at) AS dimension, any_value(score) AS score, arg_max(rated_at, loaded_at) AS rated_at FROM ratings GROUP BY rating_id")
def newest_ratings(spark, sf_dir):
    return ratings.newest(table(spark, sf_dir, "ratings"))


@query(f"WITH {_RPAIRS} SELECT * FROM pairs")
def rater_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"WITH {_CLEAN}, n AS (SELECT *, count(*) OVER (PARTITION BY target_id, dimension) AS n FROM clean) SELECT rating_id, target_id, dimension FROM n WHERE n > 1")
def rated_twice(spark, sf_dir):
    return ratings.rated_twice(ratings.newest(table(spark, sf_dir, "ratings"))).select("rating_id", "target_id", "dimension")


@query(f"""WITH {_RPAIRS}, s AS (SELECT dimension, CAST(count(*) AS DOUBLE) AS n, avg(a) AS ma, avg(b) AS mb, sum(a * a + b * b) AS q, sum(pow(a + b, 2)) / 2 AS qr, pow(sum(a + b), 2) / (2 * count(*)) AS m, (pow(sum(a), 2) + pow(sum(b), 2)) / count(*) AS qc FROM pairs GROUP BY dimension),
v AS (SELECT dimension, n, (qr - m) / (n - 1) AS r, qc - m AS c, (q - m - (qr - m) - (qc - m)) / (n - 1) AS e FROM s)
SELECT dimension, CAST(n AS BIGINT) AS n, round((r - e) / (r + (c - e) / n), 6) AS icc2k, round((r - e) / r, 6) AS icc3k FROM v""")
def intraclass(spark, sf_dir):
    return rounded(ratings.intraclass(_pairs(spark, sf_dir), ["dimension"]), "icc2k", "icc3k")


@query(f"""WITH {_RPAIRS}, v AS (SELECT DISTINCT dimension, unnest([a, b]) AS v FROM pairs), i AS (SELECT dimension, v, CAST(row_number() OVER (PARTITION BY dimension ORDER BY v) AS DOUBLE) AS i FROM v),
c AS (SELECT p.dimension, x.i AS ia, y.i AS ib FROM pairs p JOIN i x ON x.dimension = p.dimension AND x.v = p.a JOIN i y ON y.dimension = p.dimension AND y.v = p.b)
SELECT dimension, round(1 - sum(pow(ia - ib, 2)) / (sum(ia * ia) + sum(ib * ib) - 2 * sum(ia) * sum(ib) / count(*)), 6) AS kappa FROM c GROUP BY dimension""")
def weighted_kappa(spark, sf_dir):
    return rounded(ratings.weighted_kappa(_pairs(spark, sf_dir), ["dimension"]), "kappa")


@query(f"""WITH {_RPAIRS}, g AS (SELECT dimension, rater_a, rater_b, CAST(count(*) AS DOUBLE) AS n, avg(a) AS ma, avg(b) AS mb, sum(a * a + b * b) AS q, sum(pow(a + b, 2)) / 2 AS qr,
  pow(sum(a + b), 2) / (2 * count(*)) AS m, (pow(sum(a), 2) + pow(sum(b), 2)) / count(*) AS qc FROM pairs GROUP BY ALL),
t AS (SELECT dimension, rater_a, rater_b, n, (qr - m) / (n - 1) AS r, (q - m - (qr - m) - (qc - m)) / (n - 1) AS e FROM g WHERE n > 1),
v AS (SELECT DISTINCT dimension, rater_a, rater_b, unnest([a, b]) AS v FROM pairs), i AS (SELECT *, CAST(row_number() OVER (PARTITION BY dimension, rater_a, rater_b ORDER BY v) AS DOUBLE) AS i FROM v),
c AS (SELECT p.dimension, p.rater_a, p.rater_b, x.i AS ia, y.i AS ib FROM pairs p JOIN i x ON (x.dimension, x.rater_a, x.rater_b, x.v) = (p.dimension, p.rater_a, p.rater_b, p.a) JOIN i y ON (y.dimension, y.rater_a, y.rater_b, y.v) = (p.dimension, p.rater_a, p.rater_b, p.b)),
k AS (SELECT dimension, rater_a, rater_b, count(*) AS n, sum(pow(ia - ib, 2)) AS d, sum(ia * ia) + sum(ib * ib) - 2 * sum(ia) * sum(ib) / count(*) AS x FROM c GROUP BY ALL)
SELECT k.dimension, k.rater_a, k.rater_b, k.n, CASE WHEN x > 0.5 THEN round(1 - d / x, 6) END AS kappa, CASE WHEN r > 0.01 THEN round((r - e) / r, 6) END AS icc3k FROM k LEFT JOIN t USING (dimension, rater_a, rater_b)""")
def rater_pair_agreement(spark, sf_dir):
    """Kappa and intraclass correlation of every pair of raters in every dimension."""
    return rounded(ratings.pair_agreement(_pairs(spark, sf_dir)), "kappa", "icc3k")


# Curation ----------------------------------------------------------------------------------------------------------------


@query(f"WITH {S.DOCS}, c AS (SELECT doc_id, len(w) AS n FROM docs) SELECT doc_id, n FROM c ORDER BY abs(n - (SELECT avg(n) FROM c)), doc_id LIMIT 100")
def closest_to_mean(spark, sf_dir):
    rows = variation.variation_basic(docs(spark, sf_dir)).select("doc_id", F.col("LV_W").alias("n"))
    return curation.closest_to_mean(rows, "n", "doc_id", 100)


@query(f"WITH {S.TOKENS}, c AS (SELECT doc_id, count(*) AS tokens, count(*) FILTER (upos IN ('NOUN', 'VERB', 'ADJ', 'ADV')) AS lexical FROM tokens GROUP BY doc_id) SELECT * FROM c WHERE tokens BETWEEN 50 AND 200 AND lexical >= 35")
def range_filter(spark, sf_dir):
    return curation.within(density.token_counts(tokens(spark, sf_dir)).drop("lexical_strict"), tokens=(50, 200), lexical=(35, None))


@query("SELECT doc_id, source FROM documents WHERE n_chars >= 200 ORDER BY md5('0:' || doc_id), doc_id LIMIT 100")
def shuffled_sample(spark, sf_dir):
    return curation.shuffled(docs(spark, sf_dir).where("n_chars >= 200").select("doc_id", "source"), 100, "doc_id")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10")
def first_per_source(spark, sf_dir):
    return curation.first_per_group(docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", 10)


@query()
def chunked(spark, sf_dir):
    return curation.chunks(docs(spark, sf_dir).select("doc_id"), "doc_id", 8)


@query(f"""WITH {S.DOCS}, c AS (SELECT doc_id, w, CAST(len(w) AS DOUBLE) AS n, CAST(len(list_distinct(w)) AS DOUBLE) AS t FROM docs)
SELECT doc_id FROM c WHERE n < 5 OR n > 600 OR n < 35 OR (CASE WHEN n <= 25 THEN n ELSE list_avg(list_transform(range(1, len(w) - 23), lambda i: len(list_distinct(w[i:i + 24])) / 25.0)) END) > 2
  OR (n > t AND pow(ln(n), 2) / (ln(n) - ln(t)) > 300)""")
def outliers(spark, sf_dir):
    """All five conditions; HDD is nought under 35 words."""
    v = variation.lexical_variation(docs(spark, sf_dir))
    return v.where(curation.is_outlier(*map(F.col, ("LV_W", "LV_HDD", "LV_MATTR", "LV_DUGA")))).select("doc_id")


_GRADED = "(SELECT DISTINCT id, " + f"{S.level()} AS level, " + ", ".join(f"{S.grade(f'{d}_grade_{n}')} AS {d}_{n}" for d in _DIMENSIONS for n in ("1st", "2nd")) + " FROM flip_final)"


def _graded(spark, sf_dir):
    cells = [grade(f"{d}_grade_{n}").alias(f"{d}_{n}") for d in _DIMENSIONS for n in ("1st", "2nd")]
    return table(spark, sf_dir, "flip_final").select("id", T.level_name(F.col("level")).alias("level"), *cells).dropDuplicates(["id"])


_MEANS = {**{d: (d,) for d in _DIMENSIONS}, "language": ("vocab", "grammar"), "total": _DIMENSIONS}


@query("SELECT id, level, " + ", ".join(f"({' + '.join(f'{d}_{n}' for n in ('1st', '2nd') for d in of)}) / 2 AS {k}" for k, of in _MEANS.items()) + f" FROM {_GRADED}")
def averaged_grades(spark, sf_dir):
    both = lambda *d: curation.averaged_grade([f"{x}_1st" for x in d], [f"{x}_2nd" for x in d])
    return _graded(spark, sf_dir).select("id", "level", *(both(*of).alias(k) for k, of in _MEANS.items()))


_NUMBER = "CASE left(level, 2) WHEN 'A1' THEN 1 WHEN 'A2' THEN 2 WHEN 'B1' THEN 3 WHEN 'B2' THEN 4 WHEN 'C1' THEN 5 WHEN 'C2' THEN 6 END"


_PARTS_OF = [p for k in range(1, 6) for p in combinations(_DIMENSIONS, k)]


@query(f"SELECT id, {_NUMBER} AS level_number, " + ", ".join(f"({_NUMBER} - 1) * 4 * {len(p)} + {' + '.join(f'{x}_1st' for x in p)} AS \"{'_'.join(f'{x}_1st' for x in p)}\"" for p in _PARTS_OF) + f" FROM {_GRADED}")
def combined_variables(spark, sf_dir):
    """All 31."""
    rows = _graded(spark, sf_dir).withColumn("level_number", curation.level_number(F.col("level")))
    made = curation.combined_variables([f"{d}_1st" for d in _DIMENSIONS])
    return rows.select("id", "level_number", *(v.alias(k) for k, v in made.items()))


@query(f"""WITH {S.RECORDS} SELECT id, left(level, 2) AS band, CASE left(level, 2) WHEN 'B1' THEN grade WHEN 'B2' THEN grade + 4 WHEN 'C1' THEN grade + 8 END AS shifted,
  2 * ({_NUMBER} - 1) + CASE WHEN grade < 3.5 THEN 1 ELSE 2 END AS ten FROM records WHERE level IS NOT NULL AND grade IS NOT NULL""")
def level_maps(spark, sf_dir):
    rows = table(spark, sf_dir, "flip_final").select("id", T.level_name(F.col("level")).alias("level"), grade("vocab_grade_avg").alias("grade")).dropDuplicates(["id"])
    level, g = F.col("level"), F.col("grade")
    return rows.where("level IS NOT NULL AND grade IS NOT NULL").select("id", curation.level_band(level).alias("band"), curation.level_shift(level, g).alias("shifted"), curation.ten_groups(level, g).alias("ten"))


@query("SELECT CAST(round_even(n_chars / 10.0 / 10.0, 0) AS INTEGER) AS bin, count(*) AS n FROM documents GROUP BY bin")
def score_bins(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(curation.score_bin(F.col("n_chars") / 10.0).alias("bin")).agg(F.count("*").alias("n"))


def _squeezed(column: str) -> str:
    return f"trim(regexp_replace({column}, {S.SPACES}, ' ', 'g'), ' ')"


def _name(column: str) -> str:
    return f"lower({_squeezed(column)})"


@query(f"""WITH s AS (SELECT {_name("split_part(vorname, ' ', 1) || ' ' || nachname")} AS name, level AS student_level FROM (SELECT DISTINCT student_id, vorname, nachname, level FROM students)),
one AS (SELECT name, max(student_level) AS level FROM s GROUP BY name HAVING count(*) = 1), e AS (SELECT DISTINCT id, {_name('student')} AS name, {_squeezed('session')} AS session FROM flip_final WHERE student IS NOT NULL),
g AS (SELECT name, max(overall) AS overall, max(vocab) AS vocab FROM (SELECT DISTINCT id, {_name('student')} AS name, overall_grade_1st AS overall, vocab_grade_avg AS vocab FROM flip_final WHERE student IS NOT NULL) GROUP BY name HAVING count(*) = 1),
p AS (SELECT level, session, min(prompt_title) AS title FROM prompts GROUP BY ALL)
SELECT e.id, one.level, e.session, p.title, coalesce(g.overall, 'N/A') AS overall, coalesce(g.vocab, 'N/A') AS vocab FROM e JOIN one USING (name) LEFT JOIN p ON p.level = one.level AND p.session = e.session LEFT JOIN g ON g.name = e.name""")
def enriched_essays(spark, sf_dir):
    students = table(spark, sf_dir, "students").select("student_id", "vorname", "nachname", "level").distinct()
    students = students.select(T.squeezed(F.concat_ws(" ", F.substring_index("vorname", " ", 1), "nachname")).alias("name"), "level")
    records = table(spark, sf_dir, "flip_final").where("student IS NOT NULL").withColumn("name", T.squeezed(F.col("student")))
    essays = records.select("id", "name", T.squeezed(F.col("session")).alias("session")).distinct()
    grades = records.select("id", "name", F.col("overall_grade_1st").alias("overall"), F.col("vocab_grade_avg").alias("vocab")).distinct().drop("id")
    prompts = table(spark, sf_dir, "prompts").select("level", "session", F.col("prompt_title").alias("title"), F.col("prompt_description").alias("text"))
    return curation.enriched(essays, students, prompts, grades).select("id", "level", "session", "title", "overall", "vocab")


@query("""SELECT 'both' AS part, count(*) AS n FROM (SELECT level FROM prompts INTERSECT SELECT level FROM students) UNION ALL SELECT 'only_documents', count(*) FROM (SELECT level FROM documents EXCEPT SELECT level FROM prompts)
UNION ALL SELECT 'either', count(*) FROM (SELECT level FROM documents UNION SELECT level FROM prompts) UNION ALL SELECT 'bag', count(*) FROM (SELECT level FROM prompts UNION ALL SELECT level FROM students)""")
def set_operations(spark, sf_dir):
    p, s, d = (table(spark, sf_dir, t).select("level") for t in ("prompts", "students", "documents"))
    parts = {"both": p.intersect(s), "only_documents": d.exceptAll(d.limit(0)).subtract(p), "either": d.union(p).distinct(), "bag": curation.stacked(p, s)}
    out = [rows.agg(F.lit(k).alias("part"), F.count("*").alias("n")) for k, rows in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT level, session, count(*) AS n FROM (SELECT level, session FROM prompts UNION ALL SELECT level, session FROM flip_final) GROUP BY ALL")
def shared_columns(spark, sf_dir):
    return curation.stacked(table(spark, sf_dir, "prompts"), table(spark, sf_dir, "flip_final")).groupBy("level", "session").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT id, session, level FROM flip_final WHERE essay <> '' AND session NOT IN ('Session 1', 'Session 3', 'Session 5') AND vocab_grade_1st <> '' AND vocab_grade_2nd <> ''")
def dataset_query(spark, sf_dir):
    """Records with a text, outside three sessions, graded by both."""
    rows = curation.dataset(table(spark, sf_dir, "flip_final"), "essay", ("vocab_grade_1st", "vocab_grade_2nd"), "session", ("Session 1", "Session 3", "Session 5"))
    return rows.select("id", "session", "level").distinct()


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= (SELECT count(*) FROM documents) - 98 THEN 'train' ELSE 'test' END AS part FROM documents")
def positional_split(spark, sf_dir):
    """The last 98 rows are held out."""
    return curation.positional_split(docs(spark, sf_dir).select("doc_id"), "doc_id", 98)


# Texts and mutations -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS text FROM documents")
def html_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.html_text(F.col("text")).alias("text"))


@query("SELECT doc_id, replace(replace(regexp_replace(text, '<.*?>.*?<.*?>', '', 'g'), 'URL', ''), 'FORMULA', '') AS text, replace(text, chr(10), ' ') AS line FROM documents")
def plain_essay(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.plain_essay(F.col("text")).alias("text"), T.one_line(F.col("text")).alias("line"))


@query(f"SELECT doc_id, {_contracted()} AS text FROM documents")
def expanded_contractions(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", python_text.expand_contractions(F.col("text")).alias("text"))


#: SQL of a text without the signs that XML cannot hold.
_VALID = "trim(regexp_replace(text, '[^\\x09\\x0a\\x0d\\x20-\\x{d7ff}\\x{e000}-\\x{fffd}]', ' ', 'g'), chr(32) || chr(10) || chr(9) || chr(13))"


def _unescaped() -> str:
    """SQL of the entities that the texts hold; the ampersand last, as each is decoded once."""
    out = "text"
    for name, sign in {"nbsp": 160, "lt": 60, "gt": 62, "quot": 34, "#39": 39, "apos": 39, "auml": 228, "ouml": 246, "uuml": 252, "szlig": 223, "eacute": 233, "ndash": 8211, "hellip": 8230, "amp": 38}.items():
        out = f"replace({out}, '&{name};', chr({sign}))"
    return f"nfc_normalize({out})"


@query(f"SELECT doc_id, {_unescaped()} AS text FROM documents")
def composed_texts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", python_text.compose(python_text.unescape_html(F.col("text"))).alias("text"))


_SPLIT = """parts AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]+)\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents)"""


@query(f"WITH {_SPLIT} SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_id, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM parts)")
def sentence_table(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_id", "sentence"))


@query(f"WITH {_SPLIT}, x AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM parts) SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_id, hash FROM (SELECT doc_id, i, md5(array_to_string(list_concat(s[1:i - 1], s[i + 1:len(s)]), ' ')) AS hash FROM x)")
def leave_one_out(spark, sf_dir):
    return mutation.leave_one_out(docs(spark, sf_dir)).select("doc_id", "sent_id", F.md5("text").alias("hash"))


@query(f"""WITH {_SPLIT}, x AS (SELECT doc_id, i - 1 AS sent_id, string_split_regex(s[i], ' +') AS w FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM parts)),
c AS (SELECT doc_id, sent_id, w, unnest(CASE WHEN len(w) >= 6 THEN range(0, len(w) // 6) ELSE [-1] END) AS clause_id FROM x)
SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CAST(clause_id AS INTEGER) AS clause_id, CASE WHEN clause_id >= 0 THEN array_to_string(w[clause_id * 6 + 1:clause_id * 6 + 6], ' ') END AS clause FROM c""")
def clauses(spark, sf_dir):
    return mutation.clauses(docs(spark, sf_dir))


@query(f"""WITH {_SPLIT}, x AS (SELECT doc_id, s, i, string_split_regex(s[i], ' +') AS w FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM parts)),
c AS (SELECT doc_id, s, i, w, unnest(CASE WHEN len(w) >= 6 THEN range(0, len(w) // 6) ELSE [-1] END) AS k FROM x)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_id, CAST(k AS INTEGER) AS clause_id, CASE WHEN k >= 0 THEN md5(array_to_string(list_concat(s[1:i - 1], [array_to_string(w[k * 6 + 1:k * 6 + 6], ' ') || CASE WHEN k < len(w) // 6 - 1 THEN '.' ELSE '' END], s[i + 1:len(s)]), '')) END AS hash FROM c""")
def clause_mutations(spark, sf_dir):
    return mutation.clause_mutations(docs(spark, sf_dir)).select("doc_id", "sent_id", "clause_id", F.md5("text").alias("hash"))


@query(f"""WITH {_SPLIT}, x AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM parts), b AS (SELECT doc_id, {S.WORDS.format('text')} AS w FROM documents),
m AS (SELECT doc_id, i - 1 AS sent_id, {S.WORDS.format("array_to_string(list_concat(s[1:i - 1], s[i + 1:len(s)]), ' ')")} AS w FROM x),
d AS (SELECT m.doc_id, sent_id, round((CASE WHEN len(b.w) > 0 THEN len(list_distinct(b.w)) / sqrt(2.0 * len(b.w)) ELSE 0 END) - (CASE WHEN len(m.w) > 0 THEN len(list_distinct(m.w)) / sqrt(2.0 * len(m.w)) ELSE 0 END), 6) AS score_diff FROM m JOIN b USING (doc_id))
SELECT * FROM (SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, score_diff, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score_diff, sent_id) AS INTEGER) AS rank FROM d) WHERE rank <= 5""")
def ranked_sentences(spark, sf_dir):
    """Sentences by what leaving them out does to the corrected type-token ratio; the five lowest of each text."""

    def score(rows):
        return variation.variation_basic(rows).select("doc_id", F.col("LV_CTTR").alias("score"))

    out = mutation.rank_sentences(docs(spark, sf_dir), score)
    out = rounded(out, "score_diff").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("score_diff", "sent_id")))
    return out.where("rank <= 5")


_PARTNERS = "type IN ('NOUN+NOUN', 'VERB+VERB')"
_SYNONYMS = f"""{_EDGES}, s AS (SELECT lempos1 AS a, lempos2 AS b, raw_freq FROM edges WHERE {_PARTNERS} UNION ALL SELECT lempos2, lempos1, raw_freq FROM edges WHERE {_PARTNERS}),
syn AS (SELECT split_part(a, '_', 1) AS lemma, split_part(b, '_', 1) AS synonym, CAST(sum(raw_freq) AS DOUBLE) AS n FROM s GROUP BY ALL)"""


def _synonyms(t: DataFrame) -> DataFrame:
    """Stand-in thesaurus from tokens with heads: partners of one part of speech, either way, scored by how often they stand
    together. It grows with the edges; no pairs of words under a common partner are formed."""
    e = collocations.edge_table(stored(collocations.collocations(t))).where(_PARTNERS)
    ends = F.array(F.struct(F.col("lempos1").alias("a"), F.col("lempos2").alias("b")), F.struct(F.col("lempos2").alias("a"), F.col("lempos1").alias("b")))
    ways = e.select("raw_freq", F.explode(ends).alias("x")).select(*(F.substring_index(f"x.{c}", "_", 1).alias(k) for c, k in (("a", "lemma"), ("b", "synonym"))), "raw_freq")
    return ways.where("lemma <> synonym").groupBy("lemma", "synonym").agg(F.sum("raw_freq").cast("double").alias("score"))


@query()
def revised_texts(spark, sf_dir):
    t = stored(tokens(spark, sf_dir, heads=True))
    return mutation.revise(t, _synonyms(t))


# Substitution ------------------------------------------------------------------------------------------------------------------

_VARIANTS = [("colour", "color"), ("neighbour", "neighbor"), ("neighbours", "neighbors"), ("neighbourhood", "neighborhood"), ("practise", "practice"), ("centre", "center"), ("theatre", "theater"), ("globalisation", "globalization"), ("recognise", "recognize"), ("grey", "gray")]


@query(f"""WITH v AS (SELECT * FROM (VALUES {", ".join(map(str, _VARIANTS))}) AS t(british, american)), w AS (SELECT x AS word, count(*) AS n FROM (SELECT unnest({S.WORDS.format('text')}) AS x FROM documents) GROUP BY x)
SELECT word, n, coalesce(american, word) AS american FROM w LEFT JOIN v ON british = word""")
def american_spelling(spark, sf_dir):
    words = docs(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    mapping = spark.createDataFrame([(i, *v) for i, v in enumerate(_VARIANTS)], "rank int, british string, american string")
    return substitution.american(words, mapping)


@query("""WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q, v.vec_id, round(1 - list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS distance FROM q JOIN embeddings v ON v.vec_id <> q.q)
SELECT q, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, vec_id) AS rn FROM d) WHERE rn <= 5""")
def nearest_vectors(spark, sf_dir):
    """The five nearest vectors of every fiftieth one, against all; the stated queries are broadcast behind a check of their number."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"))
    near = v.join(F.broadcast(q) if q.count() <= 10_000 else q, F.col("vec_id") != F.col("q"))
    near = near.select("q", "vec_id", F.round(T.cosine_distance(F.col("e"), F.col("embedding")), 6).alias("distance"))
    return curation.first_per_group(near.withColumn("_o", F.struct("distance", "vec_id")), "q", "_o", 5).drop("_o")


_SUBS = """WITH p AS (SELECT vec_id AS pair, vec_id AS s, (vec_id + 1) AS t, [vec_id + 2, vec_id + 3, vec_id + 5, vec_id + 900000000] AS c FROM embeddings),
b AS (SELECT pair, c, s, round(1 - list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 12) AS d FROM p JOIN embeddings x ON x.vec_id = s LEFT JOIN embeddings y ON y.vec_id = t),
k AS (SELECT pair, 1 - list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(z.embedding AS DOUBLE[])) AS cd FROM (SELECT pair, s, unnest(c) AS id FROM b) u JOIN embeddings x ON x.vec_id = s JOIN embeddings z ON z.vec_id = u.id),
g AS (SELECT pair, count(*) AS n, sum(cd) AS sum, sum(ln((cd + 1) / 2)) AS logs FROM k GROUP BY pair)
SELECT b.pair, round(coalesce((d + sum) / (n + 1), -1), 6) AS "add", round(coalesce((n * d + sum) / (2 * n), -1), 6) AS bal_add,
  round(coalesce(exp((ln((d + 1) / 2) + logs) / (n + 1)), -1), 6) AS mult, round(coalesce(exp((n * ln((d + 1) / 2) + logs) / (2 * n)), -1), 6) AS bal_mult FROM b LEFT JOIN g USING (pair)"""


@query(_SUBS)
def substitution_scores(spark, sf_dir):
    """Scores of a pair for each vector, with its next as the target and three that follow, and one that is missing, as contexts."""
    v = table(spark, sf_dir, "embeddings")
    keyed = v.select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vec"))
    i = F.col("vec_id")
    pairs = v.select(i.alias("pair"), i.cast("string").alias("synonym"), (i + 1).cast("string").alias("target"), F.array(*((i + k).cast("string") for k in (2, 3, 5, 900_000_000))).alias("contexts"))
    return rounded(substitution.substitutability(pairs, keyed, keyed), "add", "bal_add", "mult", "bal_mult")


@query(f"""WITH {S.TOKENS}, up AS (SELECT t.doc_id, t.sent_id, t.pos, lower(t.dep) || 'I_' || h.lower AS context FROM tokens t JOIN tokens h ON h.doc_id = t.doc_id AND h.sent_id = t.sent_id AND h.pos = t.head_pos WHERE t.head_pos <> t.pos),
down AS (SELECT t.doc_id, t.sent_id, t.pos, lower(t.dep) || '_' || c.lower AS context FROM tokens t JOIN tokens c ON c.doc_id = t.doc_id AND c.sent_id = t.sent_id AND c.head_pos = t.pos AND c.pos <> t.pos)
SELECT * FROM up UNION ALL SELECT * FROM down""")
def context_items(spark, sf_dir):
    return substitution.contexts(tokens(spark, sf_dir, heads=True))


@query("""WITH RECURSIVE r(word, related, d) AS (SELECT n_name, n_name, 0 FROM nation UNION SELECT r.word, e.t, d + 1 FROM r JOIN (SELECT n_name AS s, r_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey) e ON e.s = r.related WHERE d < 2)
SELECT DISTINCT word, related FROM r WHERE word <> related""")
def related_words(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    relations = both.select(F.col("n_name").alias("source"), F.col("r_name").alias("target")).union(both.select("r_name", "n_name"))
    return substitution.related(relations, table(spark, sf_dir, "nation").select(F.col("n_name").alias("word")), 2)


_ONE_POS = "split_part(lempos1, '_', 2) = split_part(lempos2, '_', 2) AND type = 'NOUN+NOUN'"


@query(f"""WITH {_EDGES}, v AS (SELECT * FROM (VALUES {", ".join(map(str, _VARIANTS))}) AS t(british, american)),
s AS (SELECT split_part(lempos1, '_', 1) AS lemma, 'NOUN' AS pos, split_part(lempos2, '_', 1) AS synonym FROM edges WHERE {_ONE_POS} UNION ALL SELECT split_part(lempos2, '_', 1), 'NOUN', split_part(lempos1, '_', 1) FROM edges WHERE {_ONE_POS}),
t AS (SELECT DISTINCT lemma, upos AS pos FROM tokens WHERE upos IN ('NOUN', 'VERB', 'ADJ', 'ADV')), k AS (SELECT lemma, pos, lemma AS key FROM t UNION SELECT lemma, pos, american FROM t JOIN v ON british = lemma)
SELECT DISTINCT k.lemma, k.pos, s.synonym FROM k JOIN s ON s.lemma = k.key AND s.pos = k.pos WHERE s.synonym <> k.lemma""")
def synonym_candidates(spark, sf_dir):
    """Candidates of each lemma in both spellings from two sources: noun partners either way stand in for thesauri."""
    t = stored(tokens(spark, sf_dir, heads=True))
    e = collocations.edge_table(stored(collocations.collocations(t))).where("type = 'NOUN+NOUN'").select(*(F.split(c, "_") for c in ("lempos1", "lempos2"))).toDF("a", "b").where("a[1] = b[1]")
    sources = [e.select(F.col(f"{x}")[0].alias("lemma"), F.lit("NOUN").alias("pos"), F.col(f"{y}")[0].alias("synonym")) for x, y in ("ab", "ba")]
    mapping = spark.createDataFrame([(i, *v) for i, v in enumerate(_VARIANTS)], "rank int, british string, american string")
    targets = t.where(F.col("upos").isin("NOUN", "VERB", "ADJ", "ADV")).select("lemma", F.col("upos").alias("pos")).distinct()
    return substitution.candidates(substitution.american(targets, mapping, "lemma"), *sources)


@query()
def synonym_model_ranking(spark, sf_dir):
    """Pairs of neighbouring vectors ranked by a model over the four scores; a pair is good where both carry one label."""
    v = table(spark, sf_dir, "embeddings")
    both = v.select(F.col("vec_id").alias("pair"), "label").join(v.select((F.col("vec_id") - 1).alias("pair"), F.col("label").alias("_l")), "pair")
    rows = stored(substitution_scores(spark, sf_dir).join(both.select("pair", (F.col("label") == F.col("_l")).cast("double").alias("good")), "pair"))
    model = models.linear(list(substitution.SCORES), "good").fit(rows)
    return substitution.ranked_by_model(rows.withColumn("synonym", F.col("pair").cast("string")), model, ["good"], least=0.0).select("pair", "good", F.round("score", 6).alias("score"))


@query(f"WITH {_SYNONYMS} SELECT lemma, synonym, round(n / (n + 1), 6) AS score FROM syn WHERE lemma <> synonym AND n / (n + 1) >= {substitution.OFFERED}")
def synonym_ranking(spark, sf_dir):
    rows = _synonyms(stored(tokens(spark, sf_dir, heads=True))).withColumn("score", F.col("score") / (F.col("score") + 1))
    return rounded(substitution.offered(rows, ["lemma"]), "score")


# Models --------------------------------------------------------------------------------------------------------------------------


def _training(spark, sf_dir):
    return stored(features(spark, sf_dir).where("grade IS NOT NULL").withColumn("y", F.floor("grade").cast("double")))


def _predicted(spark, sf_dir, make):
    rows = _training(spark, sf_dir)
    return models.with_prediction(rows, make.fit(rows), "predicted").select("id", "grade", "predicted")


@query()
def forest_regression(spark, sf_dir):
    return _predicted(spark, sf_dir, models.forest_regressor(list(S.FEATURES), "grade"))


@query()
def forest_classification(spark, sf_dir):
    return _predicted(spark, sf_dir, models.forest_classifier(list(S.FEATURES), "y"))


def _det(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _cramer(k: int) -> str:
    """SQL of the k-th coefficient of a regression on x0, x1, x2 from the covariances c<ij> and those with the target, g<i>."""
    cells = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    swapped = [[f"g{i}" if j == k else c for j, c in enumerate(row)] for i, row in enumerate(cells)]
    return f"{_det(swapped)} / {_det(cells)}"


@query(f"""WITH {S.FEATURED}, t AS (SELECT id, grade AS y, "LV_W" / 100 AS x0, "LV_WT" / 100 AS x1, "LV_TTR" AS x2 FROM featured WHERE grade IS NOT NULL),
m AS (SELECT avg(y) AS my, {", ".join(f"avg(x{i}) AS m{i}, covar_pop(x{i}, y) AS g{i}" for i in range(3))}, {", ".join(f"covar_pop(x{i}, x{j}) AS c{i}{j}" for i in range(3) for j in range(i, 3))} FROM t),
b AS (SELECT my, m0, m1, m2, {", ".join(f"{_cramer(k)} AS b{k}" for k in range(3))} FROM m)
SELECT id, y AS grade, round(my + {" + ".join(f"b{k} * (x{k} - m{k})" for k in range(3))}, 4) AS predicted FROM t, b""")
def linear_regression(spark, sf_dir):
    return rounded(_predicted(spark, sf_dir, models.linear(["LV_W", "LV_WT", "LV_TTR"], "grade")), "predicted", digits=4)


@query()
def elastic_net(spark, sf_dir):
    return _predicted(spark, sf_dir, models.elastic_net(list(S.FEATURES), "grade"))


@query()
def linear_classifier(spark, sf_dir):
    return _predicted(spark, sf_dir, models.linear_classifier(list(S.FEATURES), "y"))


@query()
def perceptron(spark, sf_dir):
    return _predicted(spark, sf_dir, models.perceptron(list(S.FEATURES), "y", 5))


@query()
def cross_validation(spark, sf_dir):
    """Correlations of ten folds, over all features."""
    return models.cross_validated(_training(spark, sf_dir), lambda: models.linear(list(S.FEATURES), "grade"), "grade", "id")


@query()
def validation_summary(spark, sf_dir):
    return models.validation_summary(stored(cross_validation(spark, sf_dir)))


@query()
def significance(spark, sf_dir):
    return models.significance(_training(spark, sf_dir), list(S.FEATURES), "grade")


# Pipeline, streams, files ----------------------------------------------------------------------------------------------------------


@query()
def pipeline_vector(spark, sf_dir):
    """All components over all documents: the 35 features in their order, then the others."""
    p = Pipeline().lexical_variation().lexical_sophistication().lexical_accuracy().collocational_aspects().lexical_density()
    return p.association_scores().lexical_variation_taaled().repetition_detector().transform(docs(spark, sf_dir))


_LIST_OF = {k: f"SELECT word FROM ranked WHERE rank >= {a} AND rank < {b} AND {'rank % 2 = 0' if k == 'CA' else 'rank % 2 = 1' if k == 'CT' else 'TRUE'}" for k, (a, b) in _MATCHED.items()}


@query(f"""WITH {_EDGES}, {_DICT}, {_RANKED.removeprefix(S.TOKENS + ", ")},
r AS (SELECT f.*, metric, f.lempos1 || '<--[ ' || coalesce(CAST(round(metric, 2) + 0.0 AS VARCHAR), 'X') || ' ]--' || f.lempos2 AS r FROM found f LEFT JOIN edges USING (lempos1, lempos2, type)),
c AS (SELECT doc_id, string_agg(r, ',' || chr(10) ORDER BY sent_id, pos, ord) FILTER (metric IS NOT NULL) AS good, string_agg(r, ',' || chr(10) ORDER BY sent_id, pos, ord) FILTER (metric IS NULL) AS bad FROM r GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS number_of_words, string_agg(text, ', ' ORDER BY sent_id, pos) FILTER (ent_type = '' AND regexp_matches(text, '^[A-Za-z]+$') AND lower NOT IN (SELECT word FROM dict)) AS wrong,
  string_agg(text, ', ' ORDER BY sent_id, pos) FILTER (upos IN ('NOUN', 'VERB', 'ADJ', 'ADV') AND tag NOT IN ('NNP', 'NNPS', 'MD')) AS lexical, string_agg(text, ', ' ORDER BY sent_id, pos) FILTER (ent_type <> '') AS names,
  {", ".join(f"array_to_string(list_sort(list(DISTINCT lower(lemma)) FILTER (lower(lemma) IN ({q}))), ', ') AS {k}" for k, q in _LIST_OF.items())},
  round(count(*) FILTER (upos IN ('NOUN', 'VERB', 'ADJ', 'ADV')) / count(*), 6) AS "LD_LXUR", round(count(*) FILTER (upos || ':' || tag IN ({", ".join(f"'{x}'" for x in density.GRAMMATICAL)})) / count(*), 6) AS "LD_GRUR" FROM tokens GROUP BY doc_id)
SELECT t.doc_id, coalesce(wrong, '') AS spelling_mistakes, coalesce(good, '') AS collocations, coalesce(bad, '') AS collocation_errors, coalesce(lexical, '') AS lexical_words, coalesce(names, '') AS named_entities, number_of_words,
  {", ".join(f"coalesce({k}, '') AS {k.lower()}_words" for k in _LIST_OF)}, "LD_LXUR", "LD_GRUR" FROM t LEFT JOIN c USING (doc_id)""")
def diagnostics(spark, sf_dir):
    """The sixteen columns beside the features of density."""
    t = stored(tokens(spark, sf_dir, heads=True))
    r = stored(lexicon.ranked_list(t))
    lists = {k: lexicon.word_list({"CA": r.where("rank % 2 = 0"), "CT": r.where("rank % 2 = 1")}.get(k, r), *b) for k, b in _MATCHED.items()}
    found = stored(collocations.collocations(t))
    measured = collocations.with_metric(found, collocations.edge_table(found))
    features = rounded(density.lexical_density(t), "LD_LXUR", "LD_GRUR")
    return sinks.diagnostics(t, accuracy.spelling_errors(t, _dictionary(spark, sf_dir)), measured, sophistication.matched_words(t, lists), list(lists), features)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@query(_ORACLES["lv_basic"])
def stream_features(spark, sf_dir):
    """The documents as a stream; its result read back once all is written."""
    where = _folder(spark)
    texts = stream.read_texts(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "documents").schema)
    out = rounded(stream.stream_features(texts), "LV_TTR", "LV_CTTR", "LV_RTTR", "LV_DUGA", "LV_MAAS", "LV_SUMM")
    stream.write_checkpointed(out, f"{where}/out", f"{where}/at").awaitTermination()
    return spark.read.parquet(f"{where}/out")


@query(_ORACLES["feedback_labels"])
def stream_feedback(spark, sf_dir):
    """Feedback on a stream of records against static thresholds. Records delivered twice get theirs twice; the read makes them one."""
    where = _folder(spark)
    given = _given(spark, sf_dir)
    texts = stream.read_texts(spark, f"{sf_dir}/flip_final.parquet", table(spark, sf_dir, "flip_final").schema)
    key = F.struct("id", T.level_name(F.col("level")).alias("level"))
    rows = stream.stream_features(texts.select(key.alias("k"), "essay"), "k", "essay").select("k.*", *S.FEATURES).where("level IS NOT NULL")
    rows = rounded(rows, *S.FEATURES)
    out = stream.stream_feedback(rows, given, list(S.FEATURES), ["level"], ["id"], size=10_000).select("id", "level", "feature", "feedback")
    stream.write_checkpointed(out, f"{where}/out", f"{where}/at").awaitTermination()
    return spark.read.parquet(f"{where}/out").distinct()


@query(f"SELECT level, CAST(doc_id AS INTEGER) AS grade, {_unescaped().removeprefix('nfc_normalize(')[:-1].replace('text', _VALID, 1)} AS text FROM documents WHERE text IS NOT NULL")
def xml_roundtrip(spark, sf_dir):
    where = _folder(spark)
    rows = docs(spark, sf_dir).where("text IS NOT NULL").select(F.col("doc_id").cast("int").alias("grade"), "level", F.regexp_replace("text", "[^\\x09\\x0a\\x0d\\x20-\\ud7ff\\ue000-\\ufffd]", " ").alias("text"))
    sinks.write_writings(rows, f"{where}/level_all.xml")
    return readers.writings(spark, f"{where}/level_all.xml").drop("file")


@query(f"""SELECT replace(essay, chr(10), ' ') AS text, TRY_CAST(vocab_grade_avg AS DOUBLE) AS grade, level FROM flip_final
WHERE essay <> '' AND regexp_matches(vocab_grade_avg, '^[0-9]+(\\.[0-9]+)?') AND TRY_CAST(vocab_grade_avg AS DOUBLE) IS NOT NULL AND level IN {curation.LEVELS}""")
def csv_roundtrip(spark, sf_dir):
    where = _folder(spark)
    sinks.write_csv(table(spark, sf_dir, "flip_final").select(F.col("essay").alias("Essay"), F.col("vocab_grade_avg").alias("Vocab_Grade_AVG"), F.col("level").alias("Level")), where)
    return readers.graded_csv(spark, where)


@query(f"WITH {_SAMPLE} SELECT lower(level) AS level, feature, round(mean, 6) AS mean, round(std, 6) AS std, count(*) OVER (PARTITION BY level) AS xml_features, round(sum(mean) OVER (PARTITION BY level), 3) AS xml_sum FROM known WHERE std IS NOT NULL")
def threshold_files(spark, sf_dir):
    """A JSON and an XML file for each level, read back."""
    where = _folder(spark)
    given = _given(spark, sf_dir).withColumn("feature_index", F.array_position(F.array(*map(F.lit, S.FEATURES)), F.col("feature")).cast("int"))
    back = []
    for level in sorted(r.level for r in given.select("level").distinct().collect()):  # a dozen levels
        one, name = given.where(F.col("level") == level).drop("level"), level.lower().replace(".", "-")
        sinks.write_threshold_json(one, f"{where}/{name}.json")
        sinks.write_threshold_xml(one, f"{where}/bin_values_level_{name}.xml")
        xml = readers.threshold_xml(spark, f"{where}/bin_values_level_{name}.xml").groupBy("level").agg(F.count("*").alias("xml_features"), F.round(F.sum("mean"), 3).alias("xml_sum"))
        back.append(readers.threshold_json(spark, f"{where}/{name}.json").crossJoin(F.broadcast(xml.withColumn("level", F.translate("level", "-", ".")))))  # one row
    return reduce(DataFrame.unionByName, back)


@query(f"WITH {S.DOCS} SELECT CAST(len(w) AS VARCHAR) AS n_words, CAST(count(*) AS VARCHAR) AS n FROM docs GROUP BY len(w)")
def frequency_file(spark, sf_dir):
    where = _folder(spark)
    sinks.write_frequencies(token_histogram(spark, sf_dir), where, "n_words")
    return readers.csv_rows(spark, where)
