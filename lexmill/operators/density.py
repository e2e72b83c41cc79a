"""Lexical density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pairs of part of speech and tag that count as grammatical words.
GRAMMATICAL = "CONJ:CC ADP:IN PART:RP VERB:MD VERB:BES ADJ:PRP$ ADJ:PDT ADJ:WDT NOUN:WP ADJ:WP$ ADV:WRB PART:TO ADV:EX INTJ:UH".split()


def is_lexical(upos: Column, tag: Column, strict: bool = True) -> Column:
    """Lexical tokens. strict: proper nouns and modals are not; loose: the parts of speech alone decide."""
    loose = upos.isin("NOUN", "VERB", "ADJ", "ADV")
    return loose & ~tag.isin("NNP", "NNPS", "MD") if strict else loose


def lexical_density(tokens: DataFrame) -> DataFrame:
    """tokens to (doc_id, LD_LXUR, LD_GRUR): shares of lexical and of grammatical words of all tokens, punctuation included."""
    grammatical = F.concat_ws(":", "upos", "tag").isin(GRAMMATICAL)
    n = F.count("*")
    return tokens.groupBy("doc_id").agg(
        (F.count_if(is_lexical(F.col("upos"), F.col("tag"), strict=False)) / n).alias("LD_LXUR"), (F.count_if(grammatical) / n).alias("LD_GRUR")
    )


def token_counts(tokens: DataFrame) -> DataFrame:
    """tokens to (doc_id, tokens, lexical, lexical_strict)."""
    return tokens.groupBy("doc_id").agg(
        F.count("*").alias("tokens"), F.count_if(is_lexical(F.col("upos"), F.col("tag"), strict=False)).alias("lexical"),
        F.count_if(is_lexical(F.col("upos"), F.col("tag"))).alias("lexical_strict"),
    )
