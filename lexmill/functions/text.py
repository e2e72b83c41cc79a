"""Text expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode spaces that trim() leaves in place.
SPACES = "[\\s\\u00a0\\u2000-\\u200b\\u202f\\u3000\\ufeff]+"


def squeezed(text: Column) -> Column:
    """Runs of any white space become one blank; ends are trimmed. Null stays null."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def folded_name(name: Column) -> Column:
    """Spelling-insensitive key of a name: case, spacing, umlauts (ä, ae, a + U+0308 and a agree) and ß are folded."""
    low = F.regexp_replace(F.lower(squeezed(name)), "\\u0308", "")
    low = F.translate(low, "äöüéèáàóòúùíìâêîôû", "aoueeaaoouuiiaeiou")
    return F.regexp_replace(F.regexp_replace(low, "ß", "ss"), "([aou])e", "$1")


def level_name(level: Column) -> Column:
    """'CEFR b1,1', 'B 1.1' and the like to 'B1.1'; null where no level is named."""
    found = F.regexp_extract(
        F.upper(F.regexp_replace(level, SPACES, "")), "^(?:CEFR)?[-:]?([ABC][12])[.,]([12])$", 0
    )
    return F.when(
        found != "",
        F.concat_ws(
            ".",
            F.regexp_extract(found, "([ABC][12])[.,]([12])$", 1),
            F.regexp_extract(found, "([ABC][12])[.,]([12])$", 2),
        ),
    )


def typed_number(typed: Column) -> Column:
    """A typed decimal number (comma or point, any spacing) as double; null for blanks and marks of missing values."""
    plain = F.replace(F.regexp_replace(typed, SPACES, ""), F.lit(","), F.lit("."))
    return F.when(plain.rlike("^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"), plain.try_cast("double"))


#: A word as the variation indices count it, and a token of the annotator.
WORD = "\\p{L}+"
TOKEN = "\\p{L}+(?:'\\p{L}+)?|\\p{N}+|[^\\s\\p{L}\\p{N}]"


def words(text: Column) -> Column:
    """Lower-cased runs of letters as an array, in order; null text gives null, blank text an empty array."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences as an array: parted at white space after . ! or ?; blank parts are dropped."""
    parts = F.split(F.regexp_replace(text, "([.!?]+)\\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def one_line(text: Column) -> Column:
    """Line breaks to blanks, one for one."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


def without_tags(text: Column, by: str = "") -> Column:
    return F.regexp_replace(text, "<[^>]+>", by)


def html_text(html: Column) -> Column:
    """Text of an HTML page: tags to blanks, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(without_tags(html, " "), "\\s+", " "))


def plain_essay(text: Column) -> Column:
    """Paired tag spans of one line removed, then the literals URL and FORMULA."""
    return F.replace(F.replace(F.regexp_replace(text, "<.*?>.*?<.*?>", ""), F.lit("URL")), F.lit("FORMULA"))


def graded(grade: Column) -> Column:
    """Whether a grade begins as a number."""
    return grade.rlike("^[0-9]+(\\.[0-9]+)?")


def lemma_or_text(lemma: Column, text: Column) -> Column:
    """The lemma in lower case, the text where the lemma is the pronoun mark."""
    return F.lower(F.when(lemma == "-PRON-", text).otherwise(lemma))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos of two vectors; null where one is null or without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1.0 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def frequency(typed: Column) -> Column:
    """'1,234' as a double; null where it is no number."""
    return F.replace(typed, F.lit(","), F.lit("")).try_cast("double")
