"""Window operators: false discovery rates, peaks of scans, neighbours in a field, map and scan plots as data."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agromix.sources.scratch import written

__all__ = ["bh_fdr", "fdr_or_q", "fdr_threshold", "hit_clusters", "manhattan", "map_density", "neighbour_adjust", "peak_clusters", "peak_runs", "qtl_peaks", "stepwise", "storey_q", "top_similar"]


def _p_values(df: DataFrame, p: str) -> Column:
    """p itself, or 10 ** -p where the largest value tells that these are -log10."""
    return F.pow(F.lit(10.0), -F.col(p)) if (df.agg(F.max(p)).first()[0] or 0) > 1 else F.col(p).cast("double")


def bh_fdr(df: DataFrame, p: str) -> DataFrame:
    """``df`` with p_adjusted (Benjamini-Hochberg) and p_log10 of it. Nulls stay null and don't count.

    min over larger p of p m / rank needs one order over all tests. p-values are first counted by value, so ties leave
    the order, and then ranged: each range's cumulative count and running minimum are stitched by a scan over ranges.
    """
    rows = df.withColumn("_p", _p_values(df, p))
    values = rows.filter("_p is not null").groupBy("_p").agg(F.count("*").alias("_c"))
    # ranges by sampled quantiles hold about as many values each; written once, so that all readers see the same ranges
    values = written(values.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_p").withColumn("_r", -F.spark_partition_id()))
    inside = Window.partitionBy("_r").orderBy("_p")
    ranges = values.groupBy("_r").agg(F.sum("_c").alias("_n"))
    before = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_m", F.sum("_n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ranked = values.join(F.broadcast(ranges), "_r").withColumn("_rank", F.col("_before") + F.sum("_c").over(inside))
    ranked = ranked.withColumn("_q", F.col("_p") * F.col("_m") / F.col("_rank"))
    least = ranked.groupBy("_r").agg(F.min("_q").alias("_least")).withColumn("_later", F.min("_least").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)))
    down = Window.partitionBy("_r").orderBy(F.desc("_p"))
    adjusted = ranked.join(F.broadcast(least.select("_r", "_later")), "_r").withColumn("p_adjusted", F.least(F.lit(1.0), F.coalesce("_later", F.lit(1.0)), F.min("_q").over(down)))
    out = rows.join(adjusted.select("_p", "p_adjusted"), "_p", "left")
    return out.withColumn("p_log10", -F.log10("p_adjusted")).drop("_p")


def fdr_threshold(adjusted: DataFrame, p: str, level: float = 0.05) -> DataFrame:
    """The original value of the test whose adjusted p is the largest below ``level``: one row (threshold), null if none."""
    return adjusted.filter(F.col("p_adjusted") < level).agg(F.max_by(p, F.struct("p_adjusted", p)).alias("threshold"))


def storey_q(df: DataFrame, p: str, lambdas: Sequence[float] = tuple(i / 20 for i in range(19))) -> DataFrame:
    """bh_fdr() with q: adjusted p times the estimated share of true nulls.

    The shares over ``lambdas`` are one aggregate; a cubic fitted to them on the driver gives the estimate at the last.
    Of fewer than five, the last share itself is the estimate.
    """
    rows = df.withColumn("_p", _p_values(df, p))
    shares = rows.agg(*(F.avg((F.col("_p") >= x).cast("double")) / (1 - x) for x in lambdas)).first()
    found = float(np.polyval(np.polyfit(lambdas, [x or 0.0 for x in shares], 3), lambdas[-1])) if len(lambdas) > 4 else float(shares[-1] or 0.0)
    pi0 = min(1.0, max(1e-8, found))
    return bh_fdr(df, p).withColumn("q", F.col("p_adjusted") * pi0)


def fdr_or_q(df: DataFrame, p: str, level: float = 0.05) -> DataFrame:
    """bh_fdr(), or where no adjusted p is under ``level`` its share by storey_q(): column p_adjusted, and method of one value."""
    adjusted = bh_fdr(df, p)
    if adjusted.filter(F.col("p_adjusted") < level).limit(1).count():
        return adjusted.withColumn("method", F.lit("BH"))
    return storey_q(df, p).withColumn("p_adjusted", F.col("q")).withColumn("p_log10", -F.log10("p_adjusted")).drop("q").withColumn("method", F.lit("q"))


def peak_runs(df: DataFrame, group: str, order: str, value: str, threshold: float) -> DataFrame:
    """Local maxima above ``threshold``; a run of equal values counts once, at its first row."""
    w = Window.partitionBy(group).orderBy(order)
    runs = df.withColumn("_prev", F.lag(value).over(w)).filter(F.col("_prev").isNull() | (F.col("_prev") != F.col(value)))
    around = runs.withColumns({"_before": F.lag(value).over(w), "_after": F.lead(value).over(w)})
    high = (F.col("_before").isNull() | (F.col("_before") < F.col(value))) & (F.col("_after").isNull() | (F.col("_after") < F.col(value)))
    return around.filter(high & (F.col(value) > threshold)).drop("_prev", "_before", "_after")


def qtl_peaks(df: DataFrame, chrom: str = "chr", pos: str = "pos", lod: str = "lod", distance: float = 10.0, most: int = 5, quantile: float = 0.95, drop: float | None = None) -> DataFrame:
    """Per chromosome, greedily the highest score above the ``quantile``, then the next at least ``distance`` away, up to ``most``.

    Only rows above the chromosome's quantile can be peaks; each round is one aggregate and one join. With ``drop``, the
    columns left and right are the nearest positions on either side whose score is lower than the peak's by more than
    that, or the chromosome's ends.
    """
    floor = df.groupBy(chrom).agg(F.percentile(lod, quantile).alias("_floor"))
    left = df.join(floor, chrom).filter(F.col(lod) > F.col("_floor")).select(chrom, pos, lod)
    out = None
    for k in range(most):
        best = left.groupBy(chrom).agg(F.max(F.struct(F.col(lod).alias("l"), (-F.col(pos)).alias("p"))).alias("b")).select(chrom, (-F.col("b.p")).alias("_pos"), F.col("b.l").alias("_lod"))
        found = best.select(chrom, F.col("_pos").alias(pos), F.col("_lod").alias(lod), F.lit(k + 1).alias("peak"))
        out = found if out is None else out.unionAll(found)
        left = left.join(best, chrom).filter(F.abs(F.col(pos) - F.col("_pos")) > distance).select(chrom, pos, lod)
    if drop is None or out is None:
        return out
    peaks = out.select(chrom, F.col(pos).alias("_pos"), F.col(lod).alias("_lod"), "peak")
    rows = df.select(chrom, pos, lod).join(peaks, chrom)  # ``most`` rows a chromosome
    low = F.col(lod) < F.col("_lod") - drop
    side = lambda f, where, end: F.coalesce(f(F.when(low & where, F.col(pos))), end(pos))
    ends = rows.groupBy(chrom, "peak", "_pos", "_lod").agg(side(F.max, F.col(pos) < F.col("_pos"), F.min).alias("left"), side(F.min, F.col(pos) > F.col("_pos"), F.max).alias("right"))
    return ends.select(chrom, F.col("_pos").alias(pos), F.col("_lod").alias(lod), "peak", "left", "right")


def hit_clusters(df: DataFrame, chrom: str, pos: str, score: str, threshold: float, gap: float) -> DataFrame:
    """Rows above ``threshold`` clustered along the chromosome where gaps exceed ``gap``; the best of each: (chrom, pos, score, n)."""
    w = Window.partitionBy(chrom).orderBy(pos)
    hits = df.filter(F.col(score) > threshold).withColumn("_new", (F.col(pos) - F.lag(pos).over(w) > gap).cast("int"))
    hits = hits.withColumn("_cluster", F.coalesce(F.sum("_new").over(w), F.lit(0)))
    best = hits.groupBy(chrom, "_cluster").agg(F.max_by(pos, F.struct(F.col(score), -F.col(pos))).alias(pos), F.max(score).alias(score), F.count("*").alias("n"))
    return best.drop("_cluster")


def peak_clusters(df: DataFrame, chrom: str, pos: str, score: str, threshold: float, clusters: int, seed: int = 1) -> DataFrame:
    """peak_runs() put into ``clusters`` k-means clusters of places along the genome, and the best peak of each: (chrom, pos, score, cluster, n)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    peaks = peak_runs(df.select(chrom, pos, score), chrom, pos, score, threshold)
    ends = df.groupBy(chrom).agg(F.max(pos).alias("_end"))
    starts = ends.select(chrom, F.coalesce(F.sum("_end").over(Window.orderBy(chrom).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row for each chromosome
    placed = peaks.join(starts, chrom).withColumn("_x", array_to_vector(F.array((F.col(pos) + F.col("_start")).cast("double"))))
    n = placed.select("_x").distinct().limit(clusters).count()
    if n < 2:
        found = placed.withColumn("cluster", F.lit(0))
    else:
        found = KMeans(k=n, featuresCol="_x", predictionCol="cluster", seed=seed).fit(placed).transform(placed)
    best = found.groupBy("cluster").agg(F.max_by(F.struct(F.col(chrom), F.col(pos)), F.struct(F.col(score), -F.col(pos))).alias("b"), F.max(score).alias(score), F.count("*").alias("n"))
    return best.select(F.col(f"b.{chrom}").alias(chrom), F.col(f"b.{pos}").alias(pos), score, "cluster", "n")


def stepwise(df: DataFrame, response: str, candidates: Sequence[str], start: str = "full", fixed: Sequence[str] = ()) -> DataFrame:
    """Linear regression on candidates, added and dropped one at a time while AIC falls: (step, action, variable, rss, aic).

    The cross-products of all candidates are one grouped sum; each step sweeps them, so the records are read once. From the
    ``full`` model or from ``none``; the intercept and ``fixed`` covariates stay. AIC is n log(rss / n) + 2 coefficients. Of equal
    steps the first candidate's is taken. Records that lack any of the columns are left out; candidates that depend on
    others don't come in.
    """
    from agromix.plans.design import build_design, gram_of
    from agromix.plans.formula import Name

    if start not in ("full", "none"):
        raise ValueError("start from the full model or from none")
    names = [*fixed, *candidates]
    rows = df.dropna("any", subset=[response, *names]).select(F.col(response).cast("double").alias(response), *(F.col(x).cast("double").alias(x) for x in names))
    gram = gram_of(build_design(rows, response, tuple(Name(x) for x in names), True, ()))
    a, n = gram.sums["units"].copy(), gram.records["units"]
    size, kept, variables = np.diag(a).copy(), 1 + len(fixed), range(1 + len(fixed), len(a) - 1)
    inside = np.zeros(len(a), bool)

    def sweep(k: int) -> None:
        """Takes a variable into the model, or out of it again."""
        nonlocal a
        d, row, col = a[k, k], a[k].copy(), a[:, k].copy()
        sign = -1.0 if inside[k] else 1.0
        a = a - np.outer(col, row) / d
        a[k], a[:, k], a[k, k] = sign * row / d, sign * col / d, -1 / d
        inside[k] = not inside[k]

    usable = lambda k: a[k, k] > 1e-9 * max(size[k], 1e-300)
    for k in range(kept) if start == "none" else range(len(a) - 1):
        if usable(k):
            sweep(k)
    criterion = lambda rss, p: float(n * np.log(max(rss, 1e-300) / n) + 2 * p)
    now = criterion(a[-1, -1], int(inside.sum()))
    path = [(0, "start", None, float(a[-1, -1]), now)]
    while True:
        best = None
        for k in variables:
            if inside[k] or usable(k):
                rss = float(a[-1, -1] - a[k, -1] ** 2 / a[k, k])  # in the model a[k, k] is negative, so this rises
                aic = criterion(rss, int(inside.sum()) + (-1 if inside[k] else 1))
                if aic < now - 1e-9 * abs(now) and (best is None or aic < best[0] - 1e-9 * abs(now)):
                    best = aic, k
        if best is None:
            return df.sparkSession.createDataFrame(path, "step int, action string, variable string, rss double, aic double")
        now, k = best
        action = "drop" if inside[k] else "add"
        sweep(k)
        path.append((len(path), action, names[k - 1], float(a[-1, -1]), now))


def neighbour_adjust(df: DataFrame, trait: str, row: str, col: str, n_rows: int = 1, n_cols: int = 2, out: str = "nnx") -> DataFrame:
    """The trait less the mean of its neighbours: n_rows up and down the column, n_cols along the row; without any, the trait.

    Each plot sends its value to the places it neighbours, so this is an equi-join of a constant number of rows per plot.
    """
    around = [(d, 0) for d in range(-n_rows, n_rows + 1) if d] + [(0, d) for d in range(-n_cols, n_cols + 1) if d]
    cells = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in around)))
    sent = df.select(F.col(row).alias("_r"), F.col(col).alias("_c"), F.col(trait).cast("double").alias("_v"), cells.alias("_d")).select((F.col("_r") + F.col("_d.r")).alias(row), (F.col("_c") + F.col("_d.c")).alias(col), "_v")
    sent = sent.join(df.select(row, col).distinct(), [row, col], "left_semi").groupBy(row, col).agg(F.avg("_v").alias("_mean"))
    return df.join(sent, [row, col], "left").withColumn(out, F.col(trait) - F.coalesce("_mean", F.lit(0.0))).drop("_mean")


def top_similar(similarity: DataFrame, n: int = 10) -> DataFrame:
    """For each row of a (row, col, value) table its n largest absolute values, ties by name."""
    w = Window.partitionBy("row").orderBy(F.desc(F.abs("value")), "col")
    return similarity.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)


def manhattan(df: DataFrame, chrom: str, pos: str, p: str) -> DataFrame:
    """What a genome scan plot shows: chromosomes end to end (cumulative) and -log10 p."""
    ends = df.groupBy(chrom).agg(F.max(pos).alias("_end"))
    starts = ends.select(chrom, F.coalesce(F.sum("_end").over(Window.orderBy(chrom).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    raw = (df.agg(F.max(p)).first()[0] or 0) <= 1
    return df.join(starts, chrom).select(chrom, pos, (F.col(pos) + F.col("_start")).alias("cumulative"), (-F.log10(p) if raw else F.col(p)).alias("score"))


def map_density(df: DataFrame, group: str = "LG", pos: str = "Position", bins: int = 20) -> DataFrame:
    """What a map plot shades: markers by group and bin of the position, all groups on the scale of the longest."""
    longest = df.agg(F.max(pos)).first()[0] or 1
    at = F.least(F.lit(bins - 1), F.floor(F.col(pos) / float(longest) * bins)).cast("int")
    return df.groupBy(group, at.alias("bin")).agg(F.count("*").alias("n"), F.max(pos).alias("end"))


