"""Toxicity by weak supervision: many voters, a generative model of them, a linear classifier on its posteriors.

Voters are words (lexicon) and beginnings of words (patterns) that set toxic training documents apart, or clean ones. Each
votes for its class where its share of the words reaches a threshold of its own, found on the labelled texts, or abstains. The generative model holds, for every voter, how often it votes on toxic and on clean
documents. Labels find the voters and give it a start; expectation maximisation then fits it to all documents that aren't
held out, each distinct text once, where a label, if there is one, is a voter that may err too. (Without any label it would
part toxic texts that share no voter, as those of two languages.) Voters that vote together within a class share one
weight, by their correlations under the posterior. The odds are calibrated against the labels by a line, and the label's
accuracy is how often it agrees with voters that are sure without it. A logistic regression over mined words and
beginnings learns from labelled texts and from those that have votes but no label, and scores every whole text.

The regression takes at most about ``bound`` labelled texts and as many unlabelled ones, by hashes; the label model and
scoring take every document. Marks are counted by families: texts whose smallest hash of five words is the same share one
count, so that a group of near copies makes no voter. Null text counts as empty and scores as a text without any known
word. Rows with a null identifier or label don't count as labelled; a label given twice counts once (the larger), and so
does a text that several rows hold. With labels of one kind only, or none, all scores are that share (0 if none). Rows
that repeat are scored alike; marks that tell equally much are taken in the order of their names. Long texts are read
whole, one at a time. Other columns pass through, but score and predicted are overwritten.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from math import log, log2
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agromix.llm.common import bounded_batches, mapped, materialise, release, text_of

__all__ = ["LabelModel", "ToxicityModel", "fit_label_model", "fit_toxicity", "held_out", "marks", "score_toxicity"]

EDGES = ".,;:!?()[]{}\"'`*%$&#<>|/\\-_=+~"
BEGINNINGS = (4, 5, 6, 7)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether CRC-32 of the identifier as text is divisible by five; such rows never train. A null identifier is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def marks(word: str) -> list[str]:
    """A word (stripped at its edges) and its beginnings, these with ^ in front; none for words without letters."""
    word = word.strip(EDGES)
    if len(word) < 3 or not word[0].isalpha():
        return []
    return [word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]


@dataclass
class LabelModel:
    """Shares of toxic and clean documents that each voter votes on, their prior, correlations of voters of one class, and what ties odds and label to labels."""

    prior: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    overlap: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    trust: float = 0.95

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of toxic by the generative model; without correlations these are Bayes' for independent voters."""
        silent = np.log((1 - self.on_toxic) / (1 - self.on_clean))
        together = np.maximum(votes @ self.overlap, 1)  # of each voter: those that vote with it, as far as they say the same
        quiet = np.maximum((1 - votes) @ self.overlap, 1)
        return np.log(self.prior / (1 - self.prior)) + (votes / together) @ np.log(self.on_toxic / self.on_clean) + ((1 - votes) / quiet) @ silent

    def posterior(self, votes: np.ndarray, gold: np.ndarray | None = None) -> np.ndarray:
        """Calibrated; ``gold`` is a label, or nan where there is none."""
        odds = self.shift + self.slope * self.odds(votes)
        if gold is not None:
            odds = odds + np.where(np.isnan(gold), 0.0, np.where(gold > 0.5, 1.0, -1.0)) * np.log(self.trust / (1 - self.trust))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def calibrated(self, votes: np.ndarray, gold: np.ndarray) -> LabelModel:
        """This model with its odds on the labels' scale, and the labels' accuracy from where the voters are sure."""
        line = _regress(np.column_stack([self.odds(votes), np.ones(len(gold))]), gold, ridge=1e-3)
        out = replace(self, slope=float(max(line[0], 0)), shift=float(line[1]))
        p = out.posterior(votes)
        sure = (p > 0.95) | (p < 0.05)
        return replace(out, trust=float(np.clip((((p > 0.5) == (gold > 0.5))[sure].sum() + 9) / (sure.sum() + 10), 0.6, 0.999)))


def _moments(model: LabelModel):
    """Of batches of (voters, label, n): sums of n p v v' and n (1 - p) v v', and the mass of both classes at (-1, -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.on_toxic)
        sums, mass = np.zeros((2, k, k)), np.zeros(2)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                votes, n = _dense(part.column(0), k), part.column(2).to_numpy().astype(float)
                p = model.posterior(votes, part.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False))
                for c, w in enumerate((n * p, n * (1 - p))):
                    sums[c] += (votes * w[:, None]).T @ votes
                    mass[c] += w.sum()
        i, j = np.nonzero(sums[0] + sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(sums[0][i, j], mass[0])), pa.array(np.append(sums[1][i, j], mass[1]))], names=["i", "j", "toxic", "clean"])

    return run


def _dense(lists: pa.ListArray, k: int) -> np.ndarray:
    votes = np.zeros((len(lists), k))
    votes[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = 1
    return votes


def fit_label_model(votes: DataFrame, start: LabelModel, for_toxic: np.ndarray, rounds: int = 12, tol: float = 1e-3) -> LabelModel:
    """Expectation maximisation from ``start`` over ``votes`` (voters array<int>, label int, n long): which voters vote, the label or null, and on how many texts.

    Voters vote for toxic or, where ``for_toxic`` is false, for clean. A round is one job over all rows; its sums, as wide
    as there are pairs of voters, come to the driver.
    """
    model, k = start, len(for_toxic)
    for _ in range(rounds):
        got = mapped(votes.select("voters", "label", "n"), _moments(model), "i int, j int, toxic double, clean double").groupBy("i", "j").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
        sums, mass = np.zeros((2, k, k)), np.zeros(2)
        for r in got:
            if r["i"] < 0:
                mass[:] = r["toxic"], r["clean"]
            else:
                sums[:, r["i"], r["j"]] = r["toxic"], r["clean"]
        shares = [(np.diag(sums[c]) + 0.5) / (mass[c] + 1) for c in (0, 1)]
        overlap = np.eye(k)
        for c, side in ((0, for_toxic), (1, ~for_toxic)):
            own = np.flatnonzero(side)
            covariance = sums[c][np.ix_(own, own)] / max(mass[c], 1) - np.outer(shares[c][own], shares[c][own])
            scale = np.sqrt(np.clip(np.diag(covariance), 1e-9, None))
            found = np.clip(covariance / scale / scale[:, None], 0, 1)
            found[found < 0.1] = 0
            np.fill_diagonal(found, 1)
            overlap[np.ix_(own, own)] = found
        new = LabelModel(float(np.clip(mass[0] / max(mass.sum(), 1), 1e-4, 1 - 1e-4)), shares[0], shares[1], overlap, trust=start.trust)
        moved = max(np.abs(new.on_toxic - model.on_toxic).max(), np.abs(new.on_clean - model.on_clean).max(), abs(new.prior - model.prior))
        model = new
        if moved < tol:
            break
    return model


@dataclass
class ToxicityModel:
    bias: float = -30.0
    length: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    voters: list[str] = field(default_factory=list)
    label_model: LabelModel | None = None


def _found(text: str, known: dict, memo: dict) -> tuple[dict[int, float], float]:
    """log2(1 + count) of the known marks of a text by index, and log2(1 + words); what a word gives is remembered, within bounds."""
    out: dict = {}
    n = 0
    for word, count in Counter(text.lower().split()).items():
        n += count
        if (got := memo.get(word)) is None:
            got = tuple(known[m] for m in marks(word) if m in known)
            if len(memo) < 300_000 and len(word) < 64:
                memo[word] = got
        for i in got:
            out[i] = out.get(i, 0) + count
    return {i: log2(1 + out[i]) for i in sorted(out)}, log2(1 + n)


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest hash of five words in a row of every text; of shorter ones that of all words."""
    for batch in batches:
        found = []
        for text in batch.column(0):
            words = text.as_py().lower().split()
            found.append(min(crc32(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(len(words) - 4, 1))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["text", "label", "family"])


def _count_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the weights of toxic and of clean texts with each mark."""
    toxic, clean = Counter(), Counter()

    def rows() -> pa.RecordBatch:
        names = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.float64()), pa.array([clean[x] for x in names], pa.float64())], names=["mark", "toxic", "clean"])

    for batch in batches:
        for text, label, weight in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            side = toxic if label else clean
            for m in {m for w in set(text.as_py().lower().split()) for m in marks(w)}:
                side[m] += weight
            if len(toxic) + len(clean) > 500_000:
                yield rows()
                toxic.clear()
                clean.clear()
    if toxic or clean:
        yield rows()


def _find_marks(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = {m: i for i, m in enumerate(names)}, {}
        for batch in batches:
            got = [_found(t.as_py(), known, memo) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([list(x) for x, _ in got], pa.list_(pa.int32())), pa.array([list(x.values()) for x, _ in got], pa.list_(pa.float64())), pa.array([x for _, x in got], pa.float64()), batch.column(1), batch.column(2)], names=["marks", "counts", "length", "label", "hash"])

    return run


def _matrix(rows: list, k: int) -> np.ndarray:
    """log2(1 + count) of ``k`` marks, log2(1 + words) and 1 of every row."""
    out = np.zeros((len(rows), k + 2))
    out[:, -1] = 1
    for i, r in enumerate(rows):
        out[i, r["marks"]] = r["counts"]
        out[i, -2] = r["length"]
    return out


def _votes(matrix: np.ndarray, voters: list) -> np.ndarray:
    return np.column_stack([(matrix[:, v] > 0) & (matrix[:, v] - matrix[:, -2] >= t) for v, t in voters]).astype(float)


def _voters(matrix: np.ndarray, gold: np.ndarray, most: int, least: int) -> tuple[list, np.ndarray]:
    """(mark, least log2 share of words) of the marks that tell most at their best threshold, up to ``most`` a class; and whether each is for toxic."""
    n, toxic = len(gold), gold.sum()
    found: tuple = ([], [])
    for v in range(matrix.shape[1] - 2):
        best = None
        for t in (-40.0, *map(float, range(-14, -1))):
            cast = (matrix[:, v] > 0) & (matrix[:, v] - matrix[:, -2] >= t)
            a, both = gold[cast].sum(), cast.sum()
            if both < least:
                break
            cells = ((a, both * toxic / n), (both - a, both * (n - toxic) / n), (toxic - a, (n - both) * toxic / n), (n - toxic - both + a, (n - both) * (n - toxic) / n))
            ratio = sum(x * log(x / e) for x, e in cells if x > 0)
            rate = (a + 0.5) / (toxic + 1) / ((both - a + 0.5) / (n - toxic + 1))
            if (rate >= 8 or rate <= 1 / 8) and (best is None or ratio > best[0] + 1e-9):
                best = ratio, t, int(rate > 1)
        if best:
            found[best[2]].append((-best[0], v, best[1]))
    sides = [[(v, t) for _, v, t in sorted(side)[:most]] for side in (found[1], found[0])]
    return sides[0] + sides[1], np.arange(len(sides[0]) + len(sides[1])) < len(sides[0])


def _regress(rows: np.ndarray, target: np.ndarray, ridge: float = 0.2, rounds: int = 12) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps; the last column is the bias and isn't shrunk."""
    beta, shrink = np.zeros(rows.shape[1]), np.append(np.full(rows.shape[1] - 1, ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        w = np.clip(p * (1 - p), 1e-6, None)
        step = np.linalg.solve((rows * w[:, None]).T @ rows + np.diag(shrink), rows.T @ (target - p) - shrink * beta)
        beta += np.clip(step, -4, 4)
    return beta


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = 20_000, n_marks: int = 400, n_voters: int = 60, least: int = 8, least_ratio: float = 12.0, label_model: bool = True) -> ToxicityModel:
    """Fits on labels of rows that are not held out; ``label_model=False`` learns from the labels alone, for comparison.

    A mark's likelihood ratio statistic must reach ``least_ratio`` and 2 log m, m being the number of marks that are tried:
    by chance alone less than one of them would.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    total = known.count()
    if total > bound:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(bound / total * (1 << 30)))
    # the broadcast holds about ``bound`` pairs of numbers, whatever the corpus
    every = docs.filter(~held_out(id_col)).select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).join(F.broadcast(known), "_id", "left")
    # copies of a text are one case, a family of near copies weighs as one: else what is rare would look telling by its copies
    rows = mapped(every.filter("label IS NOT NULL").groupBy("text").agg(F.max("label").alias("label")), _families, "text string, label int, family long")
    rows = materialise(rows)
    rows = rows.join(F.broadcast(rows.groupBy("family").agg((1 / F.count("*")).alias("weight"))), "family").select("text", "label", "weight")
    sums = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    toxic, clean = sums.get(1, 0), sums.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel(bias=30.0 if toxic else -30.0)
    counted = mapped(rows, _count_marks, "mark string, toxic double, clean double").groupBy("mark").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).filter(F.col("a") + F.col("b") >= least)
    # log-likelihood ratio of the mark and the class, signed by the direction
    both = F.col("a") + F.col("b")
    term = lambda seen, expected: F.when(seen > 1e-9, seen * F.log(seen / expected)).otherwise(0.0)
    n = float(toxic + clean)
    ratio = term(F.col("a"), both * (toxic / n)) + term(F.col("b"), both * (clean / n)) + term(toxic - F.col("a"), (n - both) * (toxic / n)) + term(clean - F.col("b"), (n - both) * (clean / n))
    counted = materialise(counted.withColumn("ratio", F.round(ratio, 6)))  # sums of weights differ in their last digits
    best = counted.filter(F.col("ratio") >= max(least_ratio, 2 * log(max(counted.count(), 1)))).orderBy(F.desc("ratio"), "mark").limit(4 * n_marks).collect()
    chosen: list = []
    for r in best:  # of a word and its beginnings, or of nested beginnings, the one that tells most is taken
        stem = r["mark"].lstrip("^")
        if all(not ((stem.startswith(c) and up) or (c.startswith(stem) and r["mark"][0] == "^")) for c, up in chosen):
            chosen.append((stem, r["mark"][0] == "^"))
        if len(chosen) >= n_marks:
            break
    names = [f"^{s}" if up else s for s, up in chosen]
    # one pass over all texts; of equal texts one row, the labelled one
    found = mapped(every.select("text", "label", F.xxhash64("text").alias("hash")), _find_marks(names), "marks array<int>, counts array<double>, length double, label int, hash long")
    found = materialise(found.groupBy("hash").agg(F.max(F.struct("label", "length", "marks", "counts")).alias("r")).select("hash", "r.*"))
    got = found.filter("label IS NOT NULL").collect()
    matrix = _matrix(got, len(names))
    gold = np.array([float(r["label"]) for r in got])
    voters, for_toxic = _voters(matrix, gold, n_voters, least)
    target, model = gold, None
    if voters and label_model:
        asked = F.create_map(*[F.lit(x) for v, t in voters for x in (v, t)])
        place = F.create_map(*[F.lit(x) for at, (v, _) in enumerate(voters) for x in (v, at)])
        cast = F.filter(F.arrays_zip("marks", "counts"), lambda m: m["counts"] - F.col("length") >= asked[m["marks"]])  # a mark that is no voter asks for null
        found = found.withColumn("voters", F.transform(cast, lambda m: place[m["marks"]]))
        votes = _votes(matrix, voters)
        share = [(votes[gold == c].sum(axis=0) + 0.5) / ((gold == c).sum() + 1) for c in (1, 0)]
        start = LabelModel(float(np.clip(gold.mean(), 1e-4, 1 - 1e-4)), share[0], share[1], np.eye(len(voters)))
        model = fit_label_model(found.groupBy("voters", "label").agg(F.count("*").alias("n")), start, for_toxic).calibrated(votes, gold)
        unlabelled = found.filter("label IS NULL AND size(voters) > 0")
        taken = int(min(1, bound / max(unlabelled.count(), 1)) * (1 << 30))
        more = _matrix(unlabelled.filter(F.pmod("hash", F.lit(1 << 30)) < taken).collect(), len(names))
        target = np.append(model.posterior(votes, gold), model.posterior(_votes(more, voters)))
        matrix = np.vstack([matrix, more])
    beta = _regress(matrix, target)
    release(rows, counted, found)
    return ToxicityModel(float(beta[-1]), float(beta[-2]), dict(zip(names, map(float, beta[:-2]), strict=True)), [names[i] for i, _ in voters], model)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from a score of 0.5)."""
    names, weights, bias, length = list(model.weights), list(model.weights.values()), model.bias, model.length
    known, memo = {m: i for i, m in enumerate(names)}, {}  # every task gets its own memo

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        found = [_found(t, known, memo) for t in texts]
        odds = [bias + length * n + sum(weights[i] * x for i, x in got.items()) for got, n in found]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(odds, dtype=float), -30, 30))))

    bounded_batches(docs.sparkSession)
    out = docs.withColumn("score", score(text_of(text_col)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
