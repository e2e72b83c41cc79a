"""The builder: components in, one row a text out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import accuracy, association, collocations, density, lexicon, repetition, sophistication, taaled, variation
from lexmill.operators.annotate import annotate
from lexmill.operators.feedback import VECTOR
from lexmill.session import buckets, drop, setting, settled, stored, stored_by, written

#: What each component needs before it.
NEEDS = {
    "spell_checker": (), "lexical_variation": (), "lexical_sophistication": (), "lexical_density": (), "collocation_preprocessor": ("spell_checker",),
    "collocation_detector": ("collocation_preprocessor",), "collocation_evaluator": ("collocation_detector",), "collocational_aspects": ("collocation_evaluator",),
    "lexical_accuracy": ("spell_checker", "collocation_evaluator"), "association_scores": ("collocation_detector",), "taaled_token_classifier": (),
    "lexical_variation_taaled": ("taaled_token_classifier",), "coreference": (), "repetition_detector": ("coreference",),
}

#: Spark's setting that drops the shuffle files of a job once its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Places of the columns of custom components begin here.
CUSTOM = 1000


@dataclass
class Resources:
    """Tables that components look words up in; those left None are derived from the corpus at hand."""

    dictionary: DataFrame | None = None
    word_lists: dict[str, DataFrame] = field(default_factory=dict)
    ranked: dict[str, DataFrame] = field(default_factory=dict)
    edges: DataFrame | None = None
    adjectives: DataFrame | None = None
    real_words: DataFrame | None = None


class Pipeline:
    """Pipeline().lexical_variation().lexical_density().transform(texts) -> one row a text.

    Components may be called in any order and more than once; what they need is added before them. A custom component is
    any function from the token table to a table with doc_id; its other columns join the row.
    """

    def __init__(self, resources: Resources | None = None, annotator: Callable[..., DataFrame] = annotate) -> None:
        self.resources, self.annotator = resources or Resources(), annotator
        self.components: list[str] = []
        self.asked: list[str] = []
        self.custom: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str) -> Pipeline:
        for other in NEEDS[name]:
            self.add(other)
        if name not in self.components:
            self.components.append(name)
        return self

    def __getattr__(self, name: str):
        if name in NEEDS:
            return lambda: self.ask(name)
        raise AttributeError(f"no component {name!r}; there are {', '.join(NEEDS)}")

    def ask(self, name: str) -> Pipeline:
        """Adds a component by name, and shows what it makes: those that others merely need work unseen."""
        if name not in NEEDS:
            raise ValueError(f"no component {name!r}; there are {', '.join(NEEDS)}")
        if name not in self.asked:
            self.asked.append(name)
        return self.add(name)

    def component(self, name: str, function: Callable[[DataFrame], DataFrame]) -> Pipeline:
        self.custom[name] = function
        return self

    def __call__(self, spark: SparkSession, text: str) -> DataFrame:
        return self.transform(spark.createDataFrame([(0, text)], "doc_id long, text string"))

    def get_pipe(self) -> list[str]:
        return [*self.components, *self.custom]

    def transform(self, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, features in the order of the vector, then all others).

        Collocations are looked for in the preprocessed texts, annotated again; all else is counted on the texts as they are.
        Asked for by name, spell_checker adds spell_errors, coreference adds coreferent_tokens (those the annotator marks),
        collocation_preprocessor adds preprocessed_text, collocation_detector adds collocations and taaled_token_classifier adds
        content_words; the arrays are in the order of the text.

        With one component the result is lazy. With more, every part is computed and stored before this returns, and on a
        cluster spark.checkpoint.dir must be set.
        """
        texts = texts.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
        spark = texts.sparkSession
        if len(self.components) + len(self.custom) < 2:
            return self._row(texts, [make() for _, make in self._parts(texts, self.annotator(texts), settled, lambda: None)])
        # Each part is a plan and a job of its own over tokens that are annotated once: one plan of all parts annotates for each
        # of them and takes too much of the driver's memory. Tokens of a text lie together, so that groups of them need no shuffle.
        own: set[str] = set()

        def kept(make: Callable[[], DataFrame]) -> DataFrame:
            before = written()
            out = settled(make)
            own.update(written() - before)
            return out

        def free() -> None:
            drop(spark, annotated)

        with setting(spark, {CLEANUP: "true"}):
            before = written()
            tokens = stored_by(self.annotator(texts.repartition(buckets(spark), "doc_id")), "doc_id")
            annotated = written() - before
            tables = [(place, stored(make()) if place >= CUSTOM else settled(make)) for place, make in self._parts(texts, tokens, kept, free)]
            drop(spark, own)
        return self._row(texts, [t for _, t in sorted(tables, key=lambda x: x[0])])

    def _parts(self, texts: DataFrame, tokens: DataFrame, kept: Callable, free: Callable) -> Iterator[tuple[int, Callable[[], DataFrame]]]:
        """(place of its columns, what makes it): first those of the tokens, after which free() is called, then those of the collocations."""
        r, has = self.resources, set(self.components)
        place = {name: 10 + i for i, name in enumerate(self.asked)}
        if "lexical_variation" in has:
            lexical = density.is_lexical(F.col("upos"), F.col("tag"))
            w = tokens.where(lexical).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "pos", "lower"))).alias("w"))
            rows = texts.select("doc_id").join(w, "doc_id", "left").withColumn("w", F.transform("w", lambda x: x["lower"]))
            yield 0, lambda: variation.lexical_variation(rows, text=None, sequence=F.col("w"))
        if "lexical_sophistication" in has:
            ranked = r.ranked or dict.fromkeys(("CA", "CT", "CG"), kept(lambda: lexicon.ranked_list(tokens)))
            lists = r.word_lists or {k: lexicon.word_list(ranked["CG"], i * 500, i * 500 + 500) for i, k in enumerate(("NG", "NA", "TC", "BS"))}
            yield 1, lambda: sophistication.lexical_sophistication(tokens, lists, ranked)
        if "spell_checker" in has:
            words = r.dictionary if r.dictionary is not None else kept(lambda: lexicon.dictionary(texts))
        if "lexical_accuracy" in has:
            yield 2, lambda: accuracy.lexical_accuracy(tokens, words)
        if "lexical_density" in has:
            yield 5, lambda: density.lexical_density(tokens)
        if "taaled_token_classifier" in has:
            real = r.real_words if r.real_words is not None else kept(lambda: lexicon.dictionary(texts, least=1))
            adjectives_of = r.adjectives if r.adjectives is not None else kept(lambda: tokens.where("tag = 'JJ'").select(F.col("lemma").alias("word")).distinct())
            # Lists too long to be broadcast would shuffle all tokens. Few words of a text are no words, and few adjectives make one of its adverbs.
            adverbs = tokens.where(F.col("tag").isin(*taaled.ADVERBS)).select(F.explode(F.array(F.regexp_replace("lemma", "ly$", ""), F.regexp_replace("lemma", "ally$", ""))).alias("word")).distinct()
            adjectives = kept(lambda: adjectives_of.select("word").distinct().join(adverbs, "word", "left_semi"))
            items, real = lexicon.without(tokens, real, kept)
            classified = taaled.classify(items, adjectives, real)
        if "lexical_variation_taaled" in has:
            yield 7, lambda: taaled.taaled_indices(classified)
        if "repetition_detector" in has:
            yield 8, lambda: repetition.repetition_counts(repetition.repetition_cells(tokens))[0]
        if "spell_checker" in place:
            yield place["spell_checker"], lambda: _in_order(accuracy.spelling_errors(tokens, words), "text", "spell_errors")
        if "coreference" in place:
            yield place["coreference"], lambda: tokens.groupBy("doc_id").agg(F.count_if("in_coref").alias("coreferent_tokens"))
        if "taaled_token_classifier" in place:
            yield place["taaled_token_classifier"], lambda: _in_order(classified.where("class = 'content'"), "item", "content_words")
        for i, f in enumerate(self.custom.values()):
            yield CUSTOM + i, lambda f=f: f(tokens)
        free()
        if "collocation_preprocessor" in has:
            plain = kept(lambda: accuracy.preprocessed(texts, words))
            clean = self.annotator(plain, heads=True) if self.annotator is annotate else self.annotator(plain)
        if "collocation_detector" in has:
            found = kept(lambda: collocations.collocations(clean))
            edges = r.edges if r.edges is not None else kept(lambda: collocations.edge_table(found))
        if has & {"lexical_accuracy", "collocational_aspects"}:
            indices = kept(lambda: collocations.collocation_indices(collocations.with_metric(found, edges)))
        if "lexical_accuracy" in has:
            yield 3, lambda: indices.select("doc_id", "LA_COL_ERR_R")
        if "collocational_aspects" in has:
            yield 4, lambda: indices.drop("LA_COL_ERR_R")
        if "association_scores" in has:
            yield 6, lambda: association.association_indices(association.scored(found, edges))
        if "collocation_preprocessor" in place:
            yield place["collocation_preprocessor"], lambda: plain.withColumnRenamed("text", "preprocessed_text")
        if "collocation_detector" in place:
            yield place["collocation_detector"], lambda: _in_order(found.withColumn("pair", F.concat_ws(" ", "lempos1", "lempos2")), "pair", "collocations")

    @staticmethod
    def _row(texts: DataFrame, tables: list[DataFrame]) -> DataFrame:
        out = texts.select("doc_id")
        for t in tables:
            out = out.join(t, "doc_id", "left")
        ordered = [c for c in VECTOR if c in out.columns]
        return out.select("doc_id", *ordered, *(c for c in out.columns if c != "doc_id" and c not in ordered))

    def pipe(self, texts: DataFrame, key: str = "doc_id", text: str = "text", as_tuples: bool = False, save_period: int | None = None, save_to: str | None = None) -> DataFrame:
        """transform() of many texts. as_tuples keeps the other columns of texts beside the features, under their names with
        `context_` before them. With save_period and save_to the rows are written as they are made, in Parquet files of at
        most so many rows, and read back; what a lost run has written stays."""
        out = self.transform(texts, key, text)
        if as_tuples:
            context = texts.select(F.col(key).alias("doc_id"), *(F.col(c).alias(f"context_{c}") for c in texts.columns if c not in (key, text)))
            out = out.join(context, "doc_id", "left")
        if save_period is None:
            return out
        if save_to is None or save_period < 1:
            raise ValueError("save_period must be positive and needs a folder to save to")
        out.write.mode("append").option("maxRecordsPerFile", save_period).parquet(save_to)
        return texts.sparkSession.read.schema(out.schema).parquet(save_to)


def _in_order(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(doc_id, name): the values of each document in the order of its text."""
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "pos", F.col(column).alias("v")))).alias("_a")).select("doc_id", F.col("_a.v").alias(name))
