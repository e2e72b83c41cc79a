"""A deterministic rule annotator: texts to tokens with tag, lemma, head and dependency.

It stands in where no language model is at hand; its tags are heuristic. Every operator takes a token table with these
columns, so a table from a model can be used instead: doc_id, sent_id, pos, text, lower, lemma, upos, tag, dep, head_pos,
is_stop, is_punct, ent_type, in_coref. The rules are SQL expressions; nothing is shuffled, as sentences stay in their row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import TOKEN, sentences

#: Closed classes: tag -> words.
CLOSED = {
    "DT": "the a an this that these those every each some any no all both another",
    "PRP": "i you he she it we they me him us them myself yourself himself herself ourselves themselves",
    "PRP$": "my your his its our their her",
    "MD": "can could will would shall should may might must",
    "VBZ": "is has does goes says",
    "VBP": "are am have do go say",
    "VBD": "was were had did went said made took came saw got gave found told thought",
    "VBN": "been done gone seen taken given known",
    "VB": "be make take come see get give find tell think know want like need",
    "TO": "to",
    "IN": "of in on at by for with from about into over under after before because although while if as than near behind between through during since until without within against among",
    "RP": "up off out",
    "CC": "and or but nor yet",
    "WDT": "which",
    "WP": "who whom what",
    "WP$": "whose",
    "WRB": "when where why how",
    "EX": "there",
    "UH": "oh yes please hello hi",
    "RB": "not very also always never often now then here too just only still again soon quite rather so",
    "JJ": "good bad big small new old young little long great other same own few many much more",
}
#: Open classes by ending, first match first.
ENDINGS = [
    ("RB", ["ly"]), ("VBG", ["ing"]), ("VBD", ["ed"]), ("NN", ["tion", "ment", "ness", "ity", "ism", "ship", "ance", "ence"]),
    ("NNS", ["tions", "ments", "ities"]), ("JJ", ["ous", "ful", "able", "ible", "ive", "ical", "less", "ic"]), ("JJS", ["est"]),
]
IRREGULAR = {
    "be": "is are am was were been being", "have": "has had having", "do": "does did done doing", "go": "goes went gone", "say": "says said", "make": "made",
    "take": "took taken", "come": "came", "see": "saw seen", "get": "got", "give": "gave given", "find": "found", "tell": "told", "think": "thought", "know": "known",
}
UPOS = {
    "NOUN": "NN NNS WP", "PROPN": "NNP NNPS", "VERB": "VB VBD VBG VBN VBP VBZ MD BES", "ADJ": "JJ JJR JJS PRP$ PDT WDT WP$", "ADV": "RB RBR RBS WRB EX",
    "PRON": "PRP", "DET": "DT", "ADP": "IN", "PART": "TO RP", "CONJ": "CC", "INTJ": "UH", "NUM": "CD",
}


def _in(words: str) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words.split()) + ")"


def tag_sql(text: str, low: str, at: str) -> str:
    """CASE that gives a token's tag from its text, its lower case and its place in the sentence."""
    lines = [f"WHEN substr({low}, 1, 1) BETWEEN '0' AND '9' THEN 'CD'", f"WHEN {low} = upper({text}) THEN '.'"]
    lines += [f"WHEN {low} IN {_in(words)} THEN '{tag}'" for tag, words in CLOSED.items()]
    lines.append(f"WHEN {at} > 0 AND substr({text}, 1, 1) <> substr({low}, 1, 1) THEN 'NNP'")
    for tag, ends in ENDINGS:
        lines.append("WHEN " + " OR ".join(f"({low} LIKE '%{e}' AND length({low}) > {len(e) + 2})" for e in ends) + f" THEN '{tag}'")
    lines.append(f"WHEN {low} LIKE '%s' AND length({low}) > 3 AND NOT ({low} LIKE '%ss' OR {low} LIKE '%us' OR {low} LIKE '%is') THEN 'NNS'")
    return f"CASE {' '.join(lines)} ELSE 'NN' END"


def retag_sql(tag: str, before: str) -> str:
    """A bare noun after a modal, 'to' or a subject pronoun is a verb."""
    return f"CASE WHEN {tag} = 'NN' AND {before} IN ('MD', 'TO') THEN 'VB' WHEN {tag} = 'NN' AND {before} = 'PRP' THEN 'VBP' ELSE {tag} END"


def upos_sql(tag: str) -> str:
    return "CASE " + " ".join(f"WHEN {tag} IN {_in(tags)} THEN '{pos}'" for pos, tags in UPOS.items()) + " ELSE 'PUNCT' END"


def lemma_sql(low: str, tag: str) -> str:
    cut = lambda n: f"left({low}, length({low}) - {n})"
    lines = [f"WHEN {low} IN {_in(forms)} THEN '{lemma}'" for lemma, forms in IRREGULAR.items()]
    lines += [
        f"WHEN {tag} = 'NNS' AND {low} LIKE '%ies' AND length({low}) > 4 THEN {cut(3)} || 'y'",
        f"WHEN {tag} = 'NNS' AND ({low} LIKE '%xes' OR {low} LIKE '%ches' OR {low} LIKE '%shes' OR {low} LIKE '%sses') THEN {cut(2)}",
        f"WHEN {tag} = 'NNS' THEN {cut(1)}",
        f"WHEN {tag} = 'VBG' AND substr({low}, length({low}) - 3, 1) = substr({low}, length({low}) - 4, 1) THEN {cut(4)}",
        f"WHEN {tag} = 'VBG' THEN {cut(3)}",
        f"WHEN {tag} = 'VBD' AND {low} LIKE '%ied' THEN {cut(3)} || 'y'",
        f"WHEN {tag} = 'VBD' AND {low} LIKE '%ed' THEN {cut(2)}",
    ]
    return f"CASE {' '.join(lines)} ELSE {low} END"


NOUNS, VERBS, ADJECTIVES, ADVERBS = "('NN', 'NNS', 'NNP', 'NNPS')", "('VB', 'VBD', 'VBG', 'VBN', 'VBP', 'VBZ')", "('JJ', 'JJR', 'JJS')", "('RB', 'RBR', 'RBS', 'WRB')"


def dep_sql(tag: str, before: str, after: str) -> str:
    """Dependency by the neighbours; the letter before the colon says where the head is: n(ext), p(revious) or s(elf)."""
    nominal = f"({after} IN {NOUNS} OR {after} IN {ADJECTIVES})"
    return f"""CASE
      WHEN {tag} IN ('DT', 'PRP$', 'WP$') AND {nominal} THEN 'n:det'
      WHEN {tag} IN {ADJECTIVES} AND {after} IN {NOUNS} THEN 'n:amod'
      WHEN {tag} IN ('NN', 'NNP') AND {after} IN {NOUNS} THEN 'n:compound'
      WHEN ({tag} IN {NOUNS} OR {tag} = 'PRP') AND ({after} IN {VERBS} OR {after} = 'MD') THEN 'n:nsubj'
      WHEN {tag} = 'MD' AND {after} IN {VERBS} THEN 'n:aux'
      WHEN {tag} IN {NOUNS} AND {before} IN {VERBS} THEN 'p:dobj'
      WHEN {tag} IN {NOUNS} AND {before} IN ('IN', 'RP') THEN 'p:pobj'
      WHEN {tag} IN {ADVERBS} AND ({after} IN {VERBS} OR {after} IN {ADJECTIVES}) THEN 'n:advmod'
      WHEN {tag} IN {ADVERBS} AND {before} IN {VERBS} THEN 'p:advmod'
      WHEN {tag} IN {ADJECTIVES} AND {before} IN {VERBS} THEN 'p:acomp'
      WHEN {tag} IN ('IN', 'RP') AND ({before} IN {NOUNS} OR {before} IN {VERBS} OR {before} IN {ADJECTIVES}) THEN 'p:prep'
      WHEN {tag} IN ('VB', 'VBG') AND ({before} IN {VERBS} OR {before} = 'TO' OR {before} IN {ADJECTIVES}) THEN 'p:xcomp'
      WHEN {tag} = '.' THEN 'p:punct'
      ELSE 's:ROOT' END"""


STOP = " ".join(CLOSED[k] for k in ("DT", "PRP", "PRP$", "MD", "TO", "IN", "RP", "CC", "WDT", "WP", "WP$", "WRB", "EX")) + " is are am was were be been has have had do does did not very"


#: Columns of a head that annotate() adds where asked.
HEADS = ("head_text", "head_lower", "head_lemma", "head_tag", "head_dep")


def annotate(texts: DataFrame, key: str = "doc_id", text: str = "text", heads: bool = False) -> DataFrame:
    """texts to tokens. Null and blank texts give no tokens; a repeated key gives its tokens again; other columns are left out.

    heads adds the text, lemma and tag of each token's head, looked up within its sentence, so that nobody has to join
    tokens with themselves.
    """
    rows = texts.select(F.col(key).alias("doc_id"), F.posexplode(sentences(F.col(text))).alias("sent_id", "_s"))
    have = []

    def made(**arrays: str) -> None:
        """One pass over the words of a sentence for each array. Going through a generator of one row keeps the optimizer from
        writing an array out wherever a later one mentions it, which would make it again for every token."""
        nonlocal rows
        have.extend(k for k in arrays if k not in have)
        rows = rows.selectExpr("doc_id", "sent_id", "inline(array(named_struct(" + ", ".join(f"'{k}', {arrays.get(k, k)}" for k in have) + ")))")

    head = "i + if(left(k, 1) = 'n', 1, if(left(k, 1) = 'p', -1, 0))"
    rows = rows.select("doc_id", "sent_id", F.explode(F.array(F.regexp_extract_all(F.col("_s"), F.lit(TOKEN), F.lit(0)))).alias("_text"))
    have.append("_text")
    made(_lower="transform(_text, x -> lower(x))")
    made(_tag=f"transform(_lower, (x, i) -> {_chain(tag_sql('get(_text, i)', 'x', 'i'))})")
    made(_tag=f"transform(_tag, (x, i) -> {_chain(retag_sql('x', 'get(_tag, i - 1)'))})")
    # The long rules run over arrays and not on exploded tokens: compiled together they make a method too long for the JVM to optimise.
    made(
        _lemma=f"transform(_lower, (x, i) -> {_chain(lemma_sql('x', 'get(_tag, i)'))})",
        _link=f"transform(_tag, (x, i) -> {_chain(dep_sql('x', 'get(_tag, i - 1)', 'get(_tag, i + 1)'))})",
    )
    more = ()
    if heads:
        made(_head=f"transform(_link, (k, i) -> {head})")
        made(**{f"_{k}": f"transform(_head, h -> get({'_link' if k == 'head_dep' else k[4:]}, h))" for k in HEADS})
        more = tuple(F.expr("substr(head_dep, 3)").alias(k) if k == "head_dep" else k for k in HEADS)
    flat = rows.select("doc_id", "sent_id", F.posexplode(F.arrays_zip(*have)).alias("pos", "t")).select("doc_id", "sent_id", "pos", *(F.col(f"t.{k}").alias(k[1:]) for k in have))
    return flat.select(
        "doc_id", "sent_id", "pos", "text", "lower", "lemma", F.expr(upos_sql("tag")).alias("upos"), "tag",
        F.expr("substr(link, 3)").alias("dep"), F.expr("pos + CASE left(link, 1) WHEN 'n' THEN 1 WHEN 'p' THEN -1 ELSE 0 END").alias("head_pos"),
        F.expr(f"lower IN {_in(STOP)}").alias("is_stop"), (F.col("tag") == ".").alias("is_punct"),
        F.when(F.col("tag") == "NNP", "NAME").otherwise("").alias("ent_type"), F.col("tag").isin("PRP", "PRP$").alias("in_coref"), *more,
    )


def _chain(case: str) -> str:
    """A CASE written by this module as nested IFs: inside lambdas Spark interprets a CASE by walking its list of branches once for each."""
    body = case.strip()[len("CASE"):-len("END")].strip()
    body, last = body.rsplit(" ELSE ", 1)
    branches = [x.split(" THEN ") for x in re.split(r"\s*\bWHEN\b ", body)[1:]]
    return "".join(f"if({when}, {then.strip()}, " for when, then in branches) + last + ")" * len(branches)


def annotate_sql(table: str, key: str = "doc_id", text: str = "text") -> str:
    """The same tokens as ANSI SQL: a chain of common table expressions ending in `tokens`."""
    over = "OVER (PARTITION BY doc_id, sent_id ORDER BY pos)"
    return f"""sents AS (
  SELECT doc_id, i - 1 AS sent_id, s[i] AS sent FROM (
    SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
      SELECT {key} AS doc_id, list_filter(list_transform(string_split(regexp_replace({text}, '([.!?]+)\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM {table}))
), raws AS (
  SELECT doc_id, sent_id, i - 1 AS pos, r[i] AS text, lower(r[i]) AS lower FROM (
    SELECT doc_id, sent_id, r, unnest(range(1, len(r) + 1)) AS i FROM (
      SELECT doc_id, sent_id, regexp_extract_all(sent, '{TOKEN.replace("'", "''")}') AS r FROM sents))
), tag1 AS (SELECT *, {tag_sql('text', 'lower', 'pos')} AS tag1 FROM raws
), tag2 AS (SELECT doc_id, sent_id, pos, text, lower, {retag_sql('tag1', f'lag(tag1) {over}')} AS tag FROM tag1
), links AS (SELECT *, {dep_sql('tag', f'lag(tag) {over}', f'lead(tag) {over}')} AS link FROM tag2
), tokens AS MATERIALIZED (
  SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CAST(pos AS INTEGER) AS pos, text, lower, {lemma_sql('lower', 'tag')} AS lemma, {upos_sql('tag')} AS upos, tag,
    substr(link, 3) AS dep, CAST(pos + CASE left(link, 1) WHEN 'n' THEN 1 WHEN 'p' THEN -1 ELSE 0 END AS INTEGER) AS head_pos,
    lower IN {_in(STOP)} AS is_stop, tag = '.' AS is_punct, CASE WHEN tag = 'NNP' THEN 'NAME' ELSE '' END AS ent_type, tag IN ('PRP', 'PRP$') AS in_coref FROM links)"""
