"""Dependency collocations, their lookup in an edge table, and the indices over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that take no part in collocations. Fixed values.
STOPWORDS = ("the", "a", "an", "are", "on", "to", "at", "every", "this")
#: Bounds of the strength bins. Fixed values.
WEAK, MEDIUM = 1.064, 1.64

_V, _N, _J, _R = "VB VBD VBG VBN VBP VBZ", "NN NNS", "JJ JJR JJS", "RB RBR RBS"
_NP = _N + " NNP NNPS"
#: Patterns in order: type, active, tags of the head, dependencies, tags of the dependent. Fixed values.
PATTERNS = [
    ("NOUN+VERB", True, _V, "nsubj", _N),
    ("NOUN+VERB", True, _N, "acl", "VBG"),
    ("NOUN+NOUN", True, _NP + " VBG", "compound conj poss nmod amod npadvmod", _NP + " VBG"),
    ("ADJ+NOUN", True, _N, "amod nmod compound advmod", _J + " VBG VBN " + _R),
    ("VERB+NOUN", True, _V, "attr dobj dative oprd ccomp nsubjpass", _NP),
    ("VERB+NOUN", True, _NP, "acl relcl advcl", "VB VBN"),
    ("VERB+NOUN", True, _V, "pobj", _N),
    ("VERB+ADJ", True, _V, "acomp oprd ccomp amod", _J),
    ("VERB+ADJ", True, _J, "auxpass", _V),
    ("VERB+VERB", True, _V + " MD", "xcomp ccomp aux", "VB VBG MD"),
    ("ADV+VERB", True, _V, "advmod expl npadvmod prt neg", _R + " RP WRB"),
    ("ADV+toVERB", True, _R + " WRB", "xcomp", "VB"),
    ("ADJ+toVERB", True, _J, "xcomp", "VB"),
    ("ADV+ADJ", True, _J, "advmod npadvmod neg", _R + " WRB"),
    ("NOUN+PREP", False, _N, "prep", "IN RP"),
    ("PREP+NOUN", False, "IN RP", "pobj", _N),
    ("DET+NOUN", False, _N, "num det predet nmod", "DT WDT WP PDT PRP$ WP$"),
    ("VERB+PREP", False, _V, "agent prep dative", "IN RP"),
    ("ADJ+PREP", False, _J + " VBG VBN", "prep", "IN RP"),
]
#: Parts of speech that a type names, by tag.
_CLASSES = {
    "NOUN": _N, "VERB": _V, "ADJ": _J, "ADV": _R + " WRB", "PREP": "IN RP", "DET": "DT WDT WP PDT PRP$ WP$", "toVERB": "VB",
}


def coarse(kind: str, tag: str) -> str | None:
    """Part of speech of a tag within a collocation type; None where the type has no rule for the tag."""
    if kind in ("NOUN+NOUN", "VERB+VERB"):
        return kind.split("+")[0]
    wider = {("ADJ+NOUN", "ADJ"): _J + " VBG VBN " + _R, ("VERB+NOUN", "NOUN"): _NP, ("ADV+VERB", "ADV"): _R + " RP WRB", ("ADJ+PREP", "ADJ"): _J + " VBG VBN"}
    return next((part for part in kind.split("+") if tag in wider.get((kind, part), _CLASSES[part]).split()), None)


def pattern_rules(active_only: bool = True) -> list[tuple]:
    """(ord, type, head_tag, dep, tag, head_pos_name, pos_name) of every combination the patterns name."""
    rules = []
    for ord_, (kind, active, heads, deps, tags) in enumerate(PATTERNS):
        if active or not active_only:
            rules += [(ord_, kind, h, d, t, coarse(kind, h), coarse(kind, t)) for h in heads.split() for d in deps.split() for t in tags.split()]
    return rules


def rule_table(spark: SparkSession, active_only: bool = True) -> DataFrame:
    return spark.createDataFrame(pattern_rules(active_only), "ord int, type string, head_tag string, dep string, tag string, head_class string, class string")


def collapsed_tag(tag: Column) -> Column:
    """NN*, VB*, JJ*, and adverb and determiner tags to one tag each; other tags stay."""
    short = F.substring(tag, 1, 2)
    return (
        F.when(short.isin("NN", "VB", "JJ", "RB"), short).when(tag.isin("RP", "WRB"), "RB").when(tag.isin("DT", "WDT", "PDT"), "DT").otherwise(tag)
    )


def dependencies(tokens: DataFrame) -> DataFrame:
    """Tokens with their heads: (doc_id, sent_id, pos, head_text, head_lemma, head_tag, dep, text, lemma, tag).

    A token table that brings the columns of the heads (annotate(heads=True)) is only projected; another one is joined with
    itself. Tokens whose head is not in their sentence give no row.
    """
    names = ("doc_id", "sent_id", "pos", "head_text", "head_lemma", "head_tag", "dep", "text", "lemma", "tag")
    if "head_lemma" in tokens.columns:
        return tokens.where("head_lemma IS NOT NULL").select(*names)
    heads = tokens.select("doc_id", "sent_id", F.col("pos").alias("head_pos"), F.col("text").alias("head_text"), F.col("lemma").alias("head_lemma"), F.col("tag").alias("head_tag"))
    return tokens.join(heads, ["doc_id", "sent_id", "head_pos"]).select(*names)


def collocations(tokens: DataFrame, active_only: bool = True, direction_fix: bool = False) -> DataFrame:
    """tokens to (doc_id, sent_id, pos, ord, lempos1, lempos2, type).

    A dependency gives one row for each pattern it matches. Stopwords, pronoun marks and words that are their own head's
    lemma give none. The dependent comes first; with direction_fix the head does where the type names it first. Rules are
    a table of fixed size, joined by hash.
    """
    deps = dependencies(tokens).where(~F.col("head_lemma").isin(*STOPWORDS, "-PRON-") & ~F.col("lemma").isin(*STOPWORDS, "-PRON-") & (F.col("head_lemma") != F.col("lemma")))
    rows = deps.join(F.broadcast(rule_table(tokens.sparkSession, active_only)), ["head_tag", "dep", "tag"])
    dependent, head = F.concat_ws("_", "lemma", "class"), F.concat_ws("_", "head_lemma", "head_class")
    first = (F.substring_index("type", "+", 1) == F.col("head_class")) & F.lit(direction_fix)
    return rows.select(
        "doc_id", "sent_id", "pos", "ord", F.when(first, head).otherwise(dependent).alias("lempos1"), F.when(first, dependent).otherwise(head).alias("lempos2"), "type"
    )


def edge_table(found: DataFrame, least: int = 2) -> DataFrame:
    """Collocations of a corpus to (lempos1, lempos2, type, metric, raw_freq): metric is the log of observed over expected.

    Pairs of fewer than `least` occurrences have no edge, and so are unknown to a lookup.
    """
    pairs = found.groupBy("lempos1", "lempos2", "type").agg(F.count("*").alias("raw_freq"))
    one = pairs.groupBy("lempos1", "type").agg(F.sum("raw_freq").alias("_r"))
    two = pairs.groupBy("lempos2", "type").agg(F.sum("raw_freq").alias("_c"))
    all_ = pairs.groupBy("type").agg(F.sum("raw_freq").alias("_n"))
    metric = F.ln(F.col("raw_freq") * F.col("_n") / (F.col("_r") * F.col("_c")))
    out = pairs.where(F.col("raw_freq") >= least).join(one, ["lempos1", "type"]).join(two, ["lempos2", "type"]).join(all_, "type")
    return out.select("lempos1", "lempos2", "type", metric.alias("metric"), "raw_freq")


def with_metric(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Collocations with the metric of their edge; null where there is none."""
    return found.join(edges.select("lempos1", "lempos2", "type", "metric"), ["lempos1", "lempos2", "type"], "left")


def rendered(found: DataFrame) -> Column:
    """l1<--[ metric or X ]--l2"""
    value = F.coalesce(F.round("metric", 2).cast("string"), F.lit("X"))
    return F.concat(F.col("lempos1"), F.lit("<--[ "), value, F.lit(" ]--"), F.col("lempos2"))


def collocation_indices(measured: DataFrame) -> DataFrame:
    """(doc_id, LA_COL_ERR_R, CA_BIN1..3, CA_BIN1_R..3_R): unmatched share, and matched collocations by strength; 0 where there are none."""
    m = F.col("metric")
    bins = {"CA_BIN1": F.count_if(m < WEAK), "CA_BIN2": F.count_if((m >= WEAK) & (m < MEDIUM)), "CA_BIN3": F.count_if(m >= MEDIUM)}
    known = F.count("metric")
    return measured.groupBy("doc_id").agg(
        F.coalesce(F.try_divide(F.count_if(m.isNull()), F.count("*")), F.lit(0.0)).alias("LA_COL_ERR_R"),
        *(v.alias(k) for k, v in bins.items()), *(F.coalesce(F.try_divide(v, known), F.lit(0.0)).alias(f"{k}_R") for k, v in bins.items()),
    )
