"""Record-level operators: missing values, traits in long form, diallel variables, overlays, level tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

__all__ = ["align_levels", "bind_blocks", "diallel_vars", "impute", "level_fill", "level_pivot", "level_table", "median_of", "na_policy", "overlay", "prop_missing", "replace_values", "scale_trait", "stack_trait", "trait_covariance"]


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NumericType)


def prop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of nulls of each column: (variable, prop_missing)."""
    counted = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return counted.unpivot([], list(columns), "variable", "prop_missing")


def fills(df: DataFrame, columns: Sequence[str], method: str = "median") -> dict[str, object]:
    """What stands in for nulls: exact median or mean of numeric columns, the first of the most common values of others."""
    if method not in ("median", "mean"):
        raise ValueError("method is median or mean")
    if not columns:
        return {}
    numbers = [c for c in columns if _numeric(df, c)]
    made = {c: F.avg(F.col(c).cast("double")) if method == "mean" else F.count(c) for c in numbers} | {c: F.mode(c, True) for c in columns if c not in numbers}
    found = df.agg(*(v.alias(c) for c, v in made.items())).first().asDict()
    if method == "median" and numbers:
        found |= median_of(df, numbers, {c: found[c] for c in numbers})
    return found


def median_of(df: DataFrame, columns: Sequence[str], counts: dict[str, int], few: int = 10_000_000) -> dict[str, float | None]:
    """Exact medians. Columns of over ``few`` values are first bracketed by approximate quantiles, so that only a few in ten thousand are ordered."""
    small = [c for c in columns if counts[c] <= few]
    out = df.agg(*(F.median(F.col(c).cast("double")).alias(c) for c in small)).first().asDict() if small else {}
    for c in (x for x in columns if x not in small):
        x, n = F.col(c).cast("double"), counts[c]
        low, high = df.agg(F.percentile_approx(x, [0.4995, 0.5005], 10_000).alias("b")).first()["b"]
        below = df.filter(x < low).count()
        inside = df.filter(x.between(low, high)).groupBy(x.alias("v")).agg(F.count("*").alias("k"))
        ends = inside.withColumn("end", F.lit(below) + F.sum("k").over(Window.orderBy("v")))
        middle = [(n + 1) // 2, n // 2 + 1]
        picked = ends.agg(*(F.min(F.when(F.col("end") >= m, F.col("v"))).alias(f"m{i}") for i, m in enumerate(middle))).first()
        out[c] = (picked[0] + picked[1]) / 2
    return out


def impute(df: DataFrame, columns: Sequence[str], method: str = "median") -> DataFrame:
    """Nulls filled as fills() says; one small row comes to the driver, data stay where they are."""
    found = fills(df, columns, method)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double") if _numeric(df, c) else F.col(c), F.lit(v)) for c, v in found.items()})


def na_policy(df: DataFrame, responses: Sequence[str], covariates: Sequence[str] = (), y: str = "exclude", x: str = "exclude") -> DataFrame:
    """Rows kept or filled before a fit. y: exclude (any response null), include (all filled), include2 (one is enough, rest filled); x: exclude or include."""
    if y not in ("exclude", "include", "include2") or x not in ("exclude", "include"):
        raise ValueError("unknown policy")
    out = df
    if y == "exclude":
        out = out.dropna("any", subset=list(responses))
    elif y == "include2":
        out = out.dropna("all", subset=list(responses))
    if x == "exclude" and covariates:
        out = out.dropna("any", subset=list(covariates))
    to_fill = [*(responses if y != "exclude" else ()), *(covariates if x == "include" else ())]
    return impute(out, to_fill) if to_fill else out


def scale_trait(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "scaled") -> DataFrame:
    """Centred by the mean and divided by the sample deviation, within groups if given; null where the deviation is 0 or unknown."""
    if by:
        stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
        joined = df.join(stats, list(by), "left")
    else:
        joined = df.crossJoin(F.broadcast(df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))))  # one row
    return joined.withColumn(out, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def stack_trait(df: DataFrame, traits: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Traits in long form: ids, trait, value and its z-score within the trait, valueS."""
    long = df.select(*ids, *(F.col(t).cast("double").alias(t) for t in traits)).unpivot(list(ids), list(traits), "trait", "value")
    return scale_trait(long, "value", ["trait"], "valueS")


def trait_covariance(df: DataFrame, traits: Sequence[str]) -> DataFrame:
    """Covariance of each pair of traits over rows that have both: (trait1, trait2, covariance, mean1)."""
    pairs = [(a, b) for a in traits for b in traits]
    both = lambda a, b: F.covar_samp(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double")))
    row = df.agg(*(both(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)), *(F.avg(t).alias(f"m_{t}") for t in traits))
    cells = [F.struct(F.lit(a).alias("trait1"), F.lit(b).alias("trait2"), F.col(f"{i}").alias("covariance"), F.col(f"m_{a}").alias("mean1")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*cells)))


def diallel_vars(df: DataFrame, par1: str, par2: str, sep: str = "-") -> DataFrame:
    """is_cross, is_self, cross_type (-1, 0, 1 by the order of the parents' names) and cross_id, the same for reciprocals."""
    a, b = F.col(par1).cast("string"), F.col(par2).cast("string")
    return df.withColumns({
        "is_cross": F.when(a == b, 0).when(a != b, 1), "is_self": F.when(a == b, 1).when(a != b, 0),
        "cross_type": F.when(a < b, -1).when(a == b, 0).when(a > b, 1),
        "cross_id": F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(sep, F.least(a, b), F.greatest(a, b))),
    })


def replace_values(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Values found in ``mapping`` are replaced, others stay."""
    return df.replace(mapping, subset=[column]) if mapping else df


def overlay(df: DataFrame, key: str, factors: Sequence[str], weights: Sequence[float] | None = None, prefix: str = "") -> DataFrame:
    """One indicator matrix for several factors: (key, level, value) summed over the factors, each with its weight."""
    weights = list(weights or [1.0] * len(factors))
    cells = F.array(*(F.struct((F.concat(F.lit(prefix), F.col(f).cast("string")) if prefix else F.col(f).cast("string")).alias("level"), F.lit(float(w)).alias("value")) for f, w in zip(factors, weights, strict=True)))
    return df.select(key, F.inline(cells)).filter("level is not null").groupBy(key, "level").agg(F.sum("value").alias("value"))


def level_fill(df: DataFrame, row: str, column: str, value: str, similarity: DataFrame) -> DataFrame:
    """level_table() over all pairs of levels, empty cells filled by the column's means of other rows, weighed by similarity (row, col, value).

    Weights are the absolute similarities; cells without any related row stay null. (row, column, mean, filled)
    """
    cells = level_table(df, row, column, value)
    columns = cells.select(column).distinct()
    every = cells.select(row).distinct().crossJoin(columns)  # the table itself has a row for each pair; Spark broadcasts the columns only if they are few
    related = similarity.filter("row <> col").select(F.col("row").alias(row), F.col("col").alias("_other"), F.col("value").alias("_s"))
    weighed = related.join(cells.withColumnsRenamed({row: "_other", "mean": "_seen"}), "_other").groupBy(row, column).agg((F.sum(F.col("_s") * F.col("_seen")) / F.nullif(F.sum(F.abs("_s")), F.lit(0.0))).alias("_fill"))
    made = every.join(cells, [row, column], "left").join(weighed, [row, column], "left")
    return made.select(row, column, "mean", F.coalesce("mean", "_fill").alias("filled"))


def level_pivot(df: DataFrame, row: str, column: str, value: str, most: int = 3000) -> DataFrame:
    """The wide form of level_table(): a row for each level of ``row``, a column for each of ``column`` (``most`` of them, checked)."""
    levels = [r[0] for r in df.select(F.col(column).cast("string")).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{column} has over {most} levels")
    return df.withColumn("_c", F.col(column).cast("string")).groupBy(row).pivot("_c", sorted(levels)).agg(F.avg(value))


def level_table(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Mean of ``value`` in each cell of two factors, in long form; level_pivot() gives the wide table."""
    return df.groupBy(row, column).agg(F.avg(value).alias("mean"))


def bind_blocks(*blocks: DataFrame, pad: float | None = None) -> DataFrame:
    """Block-diagonal binding of matrices in (row, col, value) form with 1-based integer indexes.

    Offsets are the blocks' largest indexes, one small aggregate each. ``pad`` other than None adds cells off the blocks.
    """
    sizes = [tuple(b.agg(F.max("row"), F.max("col")).first()) for b in blocks]
    out, at_row, at_col = None, 0, 0
    spans: list[tuple[int, int, int, int]] = []
    for block, (rows, cols) in zip(blocks, sizes, strict=True):
        moved = block.select((F.col("row") + at_row).alias("row"), (F.col("col") + at_col).alias("col"), F.col("value").cast("double").alias("value"))
        out = moved if out is None else out.unionAll(moved)
        spans.append((at_row, at_row + (rows or 0), at_col, at_col + (cols or 0)))
        at_row, at_col = at_row + (rows or 0), at_col + (cols or 0)
    if pad is None or out is None:
        return out
    spark = blocks[0].sparkSession
    for r0, r1, c0, c1 in spans:
        rows = spark.range(r0 + 1, r1 + 1).select(F.col("id").alias("row"))
        rest: Column = F.array_except(F.sequence(F.lit(1), F.lit(at_col)), F.sequence(F.lit(c0 + 1), F.lit(c1)))
        out = out.unionAll(rows.select("row", F.explode(rest.cast("array<bigint>")).alias("col"), F.lit(float(pad)).alias("value")))
    return out




def align_levels(data: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Levels on one side only: (level, missing_from) is "known" for levels of the data that must not be, "data" for those to pad."""
    a = data.select(F.col(column).cast("string").alias("level")).filter("level is not null").distinct()
    b = known.select(F.col(known_column).cast("string").alias("level")).filter("level is not null").distinct()
    return a.join(b, "level", "left_anti").withColumn("missing_from", F.lit("known")).unionAll(b.join(a, "level", "left_anti").withColumn("missing_from", F.lit("data")))
