"""Problem 2: text quality statistics and the rules that tell prose from lists, tables and junk."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm._figures import NAMES, Figures
from lexmill.llm._labelled import labelled
from lexmill.llm._minhash import portions

#: Figures that the rules may use: shares, none of which depends on the length of a text.
RULE_FIGURES = (
    "function_share", "verbal_share", "near_share", "sentence_share", "clause_share", "sound_share", "broken_share", "symbol_share", "digit_share",
    "vowelless_share", "bullet_lines", "distinct_share", "long_share",
)
#: Labelled documents that the rules are learned from (a documented bound; they are made, not drawn from the data).
LABELLED = 3000

Rule = list[tuple[str, str, float]]


def text_figures(texts: DataFrame, key: str = "id", text: str = "essay") -> DataFrame:
    """(key, *NAMES) of each text, whole texts, row by row without a shuffle.

    Null, empty and wordless texts have zeros; repeated rows give a row each; other columns are left out.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        figures = Figures()
        for batch in batches:
            for low, high in portions(batch.column(1)):
                part = batch.slice(low, high - low)
                out = figures(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(out[k], pa.float64()) for k in NAMES)], names=["_key", *NAMES])

    kind = texts.schema[key].dataType.simpleString()
    out = texts.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(look, f"_key {kind}, " + ", ".join(f"{k} double" for k in NAMES))
    return out.withColumnRenamed("_key", key)


class RuleList:
    """An ordered rule list by incremental reduced-error pruning: the first rule that holds says junk; none says prose."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules

    @classmethod
    def learn(cls, x: dict[str, np.ndarray], junk: np.ndarray, seed: int = 5, most: int = 12) -> RuleList:
        """Grow a rule on two thirds of the rows, prune it on the third, drop what it covers; stop at a rule that errs or covers hardly anything."""
        dice = np.random.default_rng(seed)
        open_ = np.ones(len(junk), bool)
        rules: list[Rule] = []
        while len(rules) < most and (junk & open_).any():
            grow = open_ & (dice.random(len(junk)) < 2 / 3)
            prune = open_ & ~grow
            rule = cls._pruned(cls._grown(x, junk, grow), x, junk, prune)
            held = cls._covers(rule, x) & prune
            if not rule or (junk & held).sum() < max(0.9 * held.sum(), 0.03 * (junk & prune).sum(), 5):
                break
            rules.append(rule)
            open_ &= ~cls._covers(rule, x)
        return cls(rules)

    @staticmethod
    def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, at in rule:
            out &= x[name] < at if sign == "<" else x[name] >= at
        return out

    @classmethod
    def _grown(cls, x: dict[str, np.ndarray], junk: np.ndarray, rows: np.ndarray) -> Rule:
        rule: Rule = []
        inside = rows.copy()
        while (inside & ~junk).any():
            p0, n0 = (inside & junk).sum(), (inside & ~junk).sum()
            best, gain = None, 1e-9
            for name, values in x.items():
                v = np.unique(values[inside])
                cuts = (v[1:] + v[:-1]) / 2
                if len(cuts) > 60:
                    cuts = cuts[np.linspace(0, len(cuts) - 1, 60).astype(int)]
                for at in cuts:
                    below = inside & (values < at)
                    for sign, part in (("<", below), (">=", inside & ~below)):
                        p, n = (part & junk).sum(), (part & ~junk).sum()
                        if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                            best, gain = (name, sign, float(at)), g
            if best is None:
                break
            rule.append(best)
            inside &= cls._covers([best], x)
        return rule

    @classmethod
    def _pruned(cls, rule: Rule, x: dict[str, np.ndarray], junk: np.ndarray, rows: np.ndarray) -> Rule:
        def worth(part: Rule) -> float:
            held = cls._covers(part, x) & rows
            p, n = (held & junk).sum(), (held & ~junk).sum()
            return (p - n) / (p + n) * (p / max(1, (rows & junk).sum())) ** 0.2 if p + n else -1.0

        return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=[])

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(x.values()))), bool)
        for rule in self.rules:
            out |= self._covers(rule, x)
        return out

    def sql(self) -> str:
        """The list as a CASE expression over the figures' columns."""
        lines = [f"WHEN {' AND '.join(f'{n} {s} {at!r}D' for n, s, at in rule)} THEN 'junk'" for rule in self.rules]
        return f"CASE {' '.join(lines)} ELSE 'prose' END" if lines else "'prose'"


@lru_cache(maxsize=2)
def prose_rules(size: int = LABELLED) -> RuleList:
    texts, junk = labelled(size)
    figures = Figures()(pa.array(texts))
    return RuleList.learn({k: figures[k] for k in RULE_FIGURES}, np.array(junk))


def quality(texts: DataFrame, key: str = "id", text: str = "essay", least: int = 8) -> DataFrame:
    """text_figures with `kind`: 'prose', 'junk' or, under `least` runs of letters or digits, 'short'. The learned thresholds run as SQL."""
    kind: Column = F.when(F.col("runs") < least, F.lit("short")).otherwise(F.expr(prose_rules().sql()))
    return text_figures(texts, key, text).withColumn("kind", kind)
