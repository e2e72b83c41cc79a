"""Fragments of ANSI SQL that several oracle queries share."""

from __future__ import annotations

from lexmill.operators.annotate import annotate_sql

SPACES = "'[\\s\\x{00a0}\\x{2000}-\\x{200b}\\x{202f}\\x{3000}\\x{feff}]+'"


def level(column: str = "level") -> str:
    part = lambda k: f"regexp_extract(upper(regexp_replace({column}, {SPACES}, '', 'g')), '^(?:CEFR)?[-:]?([ABC][12])[.,]([12])$', {k})"
    return f"CASE WHEN {part(1)} <> '' THEN {part(1)} || '.' || {part(2)} END"


def number(column: str) -> str:
    plain = f"replace(regexp_replace({column}, {SPACES}, '', 'g'), ',', '.')"
    return f"CASE WHEN regexp_matches({plain}, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$') THEN TRY_CAST({plain} AS DOUBLE) END"


def grade(column: str) -> str:
    return f"CASE WHEN {number(column)} BETWEEN 0 AND 4 THEN {number(column)} END"


WORDS = "regexp_extract_all(lower({0}), '\\p{{L}}+')"

#: words of every document, as `w`.
DOCS = f"docs AS (SELECT doc_id, lang, source, level, n_chars, coalesce({WORDS.format('text')}, []) AS w FROM documents)"
TOKENS = annotate_sql("documents")
RECORDS = f"""records AS (SELECT DISTINCT id, {level()} AS level, {grade('vocab_grade_avg')} AS grade, essay FROM flip_final)"""


def closed(n: str, t: str) -> str:
    """SQL of the closed-form variation indices."""
    return f"""
  CASE WHEN {n} > 0 THEN {t} / {n} ELSE 0 END AS "LV_TTR", CASE WHEN {n} > 0 THEN {t} / sqrt(2 * {n}) ELSE 0 END AS "LV_CTTR",
  CASE WHEN {n} > 0 THEN {t} / sqrt({n}) ELSE 0 END AS "LV_RTTR", CASE WHEN {n} > {t} THEN pow(ln({n}), 2) / (ln({n}) - ln({t})) ELSE 0 END AS "LV_DUGA",
  CASE WHEN {n} > {t} THEN (ln({n}) - ln({t})) / pow(ln({n}), 2) ELSE 0 END AS "LV_MAAS",
  CASE WHEN {n} > 1 AND {t} > 1 THEN ln(ln({t})) / ln(ln({n})) ELSE 0 END AS "LV_SUMM" """


FEATURES = ("LV_W", "LV_WT", "LV_TTR", "LV_CTTR", "LV_RTTR", "LV_DUGA", "LV_MAAS", "LV_SUMM")
#: (id, level, grade, features) of every record, level and grade cleaned.
FEATURED = f"""{RECORDS}, counted AS (
  SELECT id, level, grade, CAST(len(w) AS DOUBLE) AS n, CAST(len(list_distinct(w)) AS DOUBLE) AS t FROM (SELECT id, level, grade, coalesce({WORDS.format('essay')}, []) AS w FROM records)
), featured AS (SELECT id, level, grade, n AS "LV_W", t AS "LV_WT", {closed('n', 't')} FROM counted)"""
LONG = FEATURED + ", long AS (" + " UNION ALL ".join(f"SELECT id, level, grade, '{f}' AS feature, \"{f}\" AS value FROM featured WHERE level IS NOT NULL" for f in FEATURES) + ")"


def rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f'round("{n}", {digits}) AS "{n}"' for n in names)
