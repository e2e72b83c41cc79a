"""Text functions that need one left-to-right pass in Python; batches travel as Arrow."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Contractions and what they stand for. Fixed values.
CONTRACTIONS = {
    "'cause": "because", "'n'": " and ", "ain't": "am not", "aren't": "are not", "can't": "cannot", "could've": "could have", "couldn't": "could not",
    "didn't": "did not", "doesn't": "does not", "don't": "do not", "hadn't": "had not", "hasn't": "has not", "haven't": "have not", "he'd": "he had",
    "he'll": "he will", "he's": "he is", "how'd": "how did", "how'll": "how will", "how's": "how is", "I'd": "I had", "I'll": "I will", "I'm": "I am",
    "I've": "I have", "isn't": "is not", "it'd": "it had", "it'll": "it will", "it's": "it is", "let's": "let us", "ma'am": "madam",
    "mayn't": "may not", "might've": "might have", "mightn't": "might not", "must've": "must have", "mustn't": "must not", "needn't": "need not",
    "o'clock": "of the clock", "oughtn't": "ought not", "sha'n't": "shall not", "shan't": "shall not", "she'd": "she had", "she'll": "she will",
    "she's": "she is", "should've": "should have", "shouldn't": "should not", "so's": "so is", "so've": "so have", "that'd": "that had",
    "that's": "that is", "there'd": "there had", "there's": "there is", "they'd": "they had", "they'll": "they will", "they're": "they are",
    "they've": "they have", "to've": "to have", "wasn't": "was not", "we'd": "we had", "we'll": "we will", "we're": "we are", "we've": "we have",
    "weren't": "were not", "what'll": "what will", "what're": "what are", "what's": "what is", "what've": "what have", "when's": "when is",
    "when've": "when have", "where'd": "where did", "where's": "where is", "where've": "where have", "who'll": "who will", "who's": "who is",
    "who've": "who have", "why's": "why is", "why've": "why have", "will've": "will have", "won't": "will not", "would've": "would have",
    "wouldn't": "would not", "y'all": "you all", "you'd": "you had", "you'll": "you will", "you're": "you are", "you've": "you have",
}
#: The look ahead spares most places of a text the search through all of them.
_ANY = re.compile(f"(?=[a-z]{{0,{max(x.index(chr(39)) for x in CONTRACTIONS)}}}')(?:{'|'.join(map(re.escape, CONTRACTIONS))})", re.IGNORECASE)


def expanded(text: str | None) -> str | None:
    """A form of I in another case has no entry and drops out, as the table's keys are looked up as written or in lower case."""
    if text is None or "'" not in text and "´" not in text:  # every contraction has the mark
        return text
    return _ANY.sub(lambda m: CONTRACTIONS.get(m[0]) or CONTRACTIONS.get(m[0].lower()) or "", text.replace("´", "'")).replace("'", "")


@F.pandas_udf(StringType())
def _expand(text: pd.Series) -> pd.Series:
    return text.map(expanded)


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def expand_contractions(text: Column) -> Column:
    return _expand(text)


def unescape_html(text: Column) -> Column:
    return _unescape(text)


def compose(text: Column) -> Column:
    """Unicode normal form C."""
    return _compose(text)
