"""Quality rules: an ordered decision list of threshold conjunctions, learned by sequential covering, run by Spark alone.

Training reads statistics only: the labelled documents' features are cut into quantile bins, and each step of growing a
rule asks for counts of good and bad rows by feature and bin among the rows that the rule so far covers. A rule grows
by the condition of greatest information gain, is pruned on the rows set aside, and rows it covers leave. What comes
out is an ordered list; as a Spark expression it is CASE WHEN rule 1 THEN reject ... ELSE keep.

Null text has no words and one line without any. Rows without a label or with a null identifier do not train. With no
labelled rows of both kinds the list is empty and only the base rules reject. Documents that repeat an identifier are
judged each by its own text; a label given several times counts once (the smallest). Other columns pass through, those
named like a result are replaced. Long texts are counted whole. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agromix.llm.common import apart, hidden, materialise, text_of

__all__ = ["BASE", "FEATURES", "Condition", "Rule", "base_statistics", "features", "learn_rules", "quality_rules", "verdict"]

BLANK = r"[\x20\x09-\x0D]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols_per_word", "chars_per_word", "dup_line_share", "repeat_share", "upper_share", "exclaim_per_word", "digit_share", "bars_per_word", "words_per_line", "n_words"]


def _get(array: str, i: Column) -> Column:
    return F.get(array, i)


def base_statistics(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """``docs`` with BASE and base_failed; all counts are of the whole text."""
    text = text_of(text_col)
    out = docs.drop(*BASE, "base_failed").withColumn("_words", F.filter(F.split(text, BLANK), lambda w: w != ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({"_hash": F.transform("_words", lambda w: F.xxhash64(w)), "_lines": lines})
    starts = F.when(F.size("_hash") >= window, F.sequence(F.lit(0), F.size("_hash") - window)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_windows", F.transform(starts, lambda i: F.xxhash64(*(_get("_hash", i + k) for k in range(window)))))
    # windows sorted by hash and place: those equal to a neighbour are repeats, and their places sorted give what they cover
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(again, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j, k: F.coalesce(x["h"] == F.get("_sorted", j + k)["h"], F.lit(False))
    out = out.withColumn("_places", F.array_sort(F.transform(F.filter("_sorted", lambda x, j: (F.when(j > 0, same(x, j, -1)).otherwise(False)) | same(x, j, 1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_places", lambda p, j: F.when(j == 0, F.lit(window)).otherwise(F.least(F.lit(window), p - F.get("_places", j - 1)))), F.lit(0).cast("long"), lambda a, x: a + x)
    n_words = F.size("_words").cast("long")
    out = out.withColumns({
        "n_words": n_words,
        "word_chars": F.length(F.regexp_replace(text, BLANK, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    return out.withColumn("_n_lines", F.size("_lines")).drop("_words", "_hash", "_windows", "_sorted", "_places", "_lines")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """base_statistics() and FEATURES in columns of their own, prefixed with f_."""
    text = text_of(text_col)
    out = base_statistics(docs, text_col)
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    without = lambda what: F.length(text) - F.length(F.regexp_replace(text, what, ""))
    made = {
        "symbols_per_word": F.col("n_symbols") / words, "chars_per_word": F.col("word_chars") / words, "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words, "upper_share": without("[A-Z]+") / chars, "exclaim_per_word": without("!+") / words, "digit_share": without("[0-9]+") / chars,
        "bars_per_word": without(r"\|+") / words, "words_per_line": F.col("n_words") / F.greatest(F.col("_n_lines"), F.lit(1)), "n_words": F.col("n_words").cast("double"),
    }
    return out.withColumns({f"f_{k}": v.cast("double") for k, v in made.items()}).drop("_n_lines")


@dataclass(frozen=True)
class Condition:
    """feature >= value, or feature < value."""

    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        return F.col(f"f_{self.feature}") >= self.value if self.above else F.col(f"f_{self.feature}") < self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.value:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.conditions))

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _gain(bad: float, good: float, bad0: float, good0: float) -> float:
    """Information gain of a condition (FOIL): bad rows kept, times the bits by which their share improved."""
    return bad * (math.log2((bad + 1) / (bad + good + 2)) - math.log2((bad0 + 1) / (bad0 + good0 + 2)))


def learn_rules(labelled: DataFrame, label: str = "good", bins: int = 32, most_rules: int = 12, most_conditions: int = 3, purity: float = 0.9, least_bad: int = 5) -> list[Rule]:
    """The list that rejects, from rows with f_ columns, ``label`` (0 or 1) and ``grow`` (false: set aside for pruning).

    ``labelled`` is materialised. Each step reads counts of at most features x bins groups. Rules stop when the best one is less pure than ``purity``
    or finds fewer than ``least_bad`` bad rows, among those that train and among those set aside.
    """
    columns = [f"f_{f}" for f in FEATURES]
    rows = labelled.select(*columns, F.col(label).alias("label"), "grow")
    edges_of = rows.agg(*(F.percentile_approx(F.when(F.col("label") == bad, F.col(c)), [i / bins for i in range(1, bins)], 2000).alias(f"{c}_{bad}") for c in columns for bad in (0, 1))).first()
    edges = {f: sorted({x for bad in (0, 1) for x in (edges_of[f"f_{f}_{bad}"] or ())}) for f in FEATURES}
    binned = {f: sum((F.when(F.col(f"f_{f}") >= x, 1).otherwise(0) for x in edges[f]), F.lit(0)) if edges[f] else F.lit(0) for f in FEATURES}
    long_form = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), binned[f].alias("bin")) for f in FEATURES))).alias("x")

    def counts(left: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        out: dict = {f: {} for f in FEATURES}
        for r in left.select("label", long_form).groupBy("x.feature", "x.bin").agg(F.sum(F.expr("1 - label")).alias("bad"), F.sum("label").alias("good")).collect():
            out[r["feature"]][r["bin"]] = (r["bad"], r["good"])
        return out

    def shares(conditions: list[tuple[Condition, ...]], left: DataFrame) -> list[tuple[int, int]]:
        aggregates = [F.sum(F.when(Rule(c).column(), F.expr(x)).otherwise(0)) for c in conditions for x in ("1 - label", "label")]
        got = left.agg(*aggregates).first()
        return [(got[2 * i] or 0, got[2 * i + 1] or 0) for i in range(len(conditions))]

    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = rows.filter(~reduce(lambda a, b: a | b, (r.column() for r in rules), F.lit(False)))
        grown: list[Condition] = []
        while len(grown) < most_conditions:
            found = counts((left.filter(Rule(tuple(grown)).column()) if grown else left).filter("grow"))
            bad0, good0 = (sum(x[i] for x in found[FEATURES[0]].values()) for i in (0, 1))
            if bad0 < least_bad or (grown and good0 == 0):
                break
            best: tuple = (1e-9, None)
            for f in FEATURES:
                bad = good = 0
                for k, value in enumerate(edges[f]):
                    bad, good = bad + found[f].get(k, (0, 0))[0], good + found[f].get(k, (0, 0))[1]
                    best = max(best, (_gain(bad, good, bad0, good0), Condition(f, False, value)), (_gain(bad0 - bad, good0 - good, bad0, good0), Condition(f, True, value)), key=lambda x: x[0])
            if best[1] is None:
                break
            grown.append(best[1])
        if not grown:
            break
        options = [tuple(grown[:n]) for n in range(1, len(grown) + 1)]
        held, trained = shares(options, left.filter("not grow")), shares(options, left.filter("grow"))
        worth = [(b - g) / (b + g) if b + g else 0 for b, g in held]
        i = max(range(len(options)), key=lambda i: (worth[i], -i))
        bad, good = held[i][0] + trained[i][0], held[i][1] + trained[i][1]
        if bad < least_bad or bad < purity * (bad + good) or held[i][0] < purity * sum(held[i]):
            break
        rules.append(Rule(options[i]))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: true keeps."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.column(), False).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: DataFrame | None = None) -> DataFrame:
    """``docs`` with BASE, base_failed and kept; the list learns from labelled rows of ``train_docs`` (by default ``docs``)."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("good")).filter("_id is not null and good in (0, 1)").groupBy("_id").agg(F.min("good").alias("good"))
    source = (docs if train_docs is None else train_docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    trained = features(source.join(known.hint("shuffle_hash"), "_id"), "_text").withColumn("grow", F.pmod(F.xxhash64("_id"), F.lit(3)) != 0)
    # written first: a filter on base_failed would be pushed down as its whole definition, window arrays and all
    trained = materialise(trained.select(*(f"f_{f}" for f in FEATURES), "base_failed", "good", "grow"))
    rules = learn_rules(trained.filter(~F.col("base_failed")))
    out = features(docs.select(*hidden(docs), F.col(text_col).alias("_text")), "_text")
    # the last term is always true; being non-deterministic, it keeps filters on kept above the features' definitions
    kept = ~F.col("base_failed") & verdict(rules) & (F.monotonically_increasing_id() >= 0)
    return out.select(*apart(docs, *BASE, "base_failed", "kept"), *BASE, "base_failed", kept.alias("kept"))
