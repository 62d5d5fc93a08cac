"""Marker operators: frequencies and filters, letters to dosages and back, hybrids, linkage disequilibrium, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["build_hybrids", "filter_markers", "from_letters", "ld_decay", "ld_unlinked", "marker_stats", "ne_marker", "to_letters", "two_way_imputation"]

#: IUPAC codes of single letters and the pairs of bases they stand for.
IUPAC = {"A": "AA", "C": "CC", "G": "GG", "T": "TT", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC"}


def marker_stats(markers: DataFrame, marker: str = "marker", dosage: str = "dosage", ploidy: int = 2) -> DataFrame:
    """Per marker: calls, missing share, allele frequency p (dosage -ploidy/2..ploidy/2), maf and variance."""
    x = F.col(dosage).cast("double")
    p = F.avg(x + ploidy / 2) / ploidy
    out = markers.groupBy(marker).agg(F.count(x).alias("n_calls"), F.avg(x.isNull().cast("double")).alias("missing"), p.alias("p"), F.var_samp(x).alias("variance"))
    return out.withColumn("maf", F.least(F.col("p"), 1 - F.col("p")))


def filter_markers(markers: DataFrame, marker: str = "marker", dosage: str = "dosage", min_maf: float = 0.0, ploidy: int = 2) -> DataFrame:
    """Cells of markers that are seen at all, vary, and have a minor allele frequency above ``min_maf``."""
    good = marker_stats(markers, marker, dosage, ploidy).filter((F.col("n_calls") > 0) & (F.col("maf") > min_maf) & (F.col("variance") > 0))
    return markers.join(good.select(marker), marker, "left_semi")


def from_letters(calls: DataFrame, ploidy: int = 2, maf: float = 0.0, multi: bool = True, imp: bool = True, by_allele: bool = False, references: DataFrame | None = None) -> DataFrame:
    """Dosages 0..ploidy from calls (id, marker, call) of letters: (id, marker, dosage, Alt, Ref).

    Single letters are read as IUPAC pairs. The reference allele is the first of the marker's alleles in the order A, C,
    G, T, others; the dosage counts the other alleles, or with ``references`` (marker, Alt, Ref) the Ref allele. Markers
    never called, with more than two alleles (``multi`` drops them) or a frequency under ``maf`` go; missing calls get the
    most common dosage (the lowest if tied). by_allele gives presence of each allele: (id, marker, allele, present).
    """
    pairs = F.create_map(*(F.lit(x) for kv in IUPAC.items() for x in kv))
    raw = F.upper(F.trim("call"))
    known = F.when(raw.isin("", "N", "NN", "-", "--", "NA"), None).otherwise(raw)
    cells = calls.select("id", "marker", F.when(F.length(known) == 1, F.element_at(pairs, known) if ploidy == 2 else known).otherwise(known).alias("call"))
    order = F.coalesce(F.nullif(F.instr(F.lit("ACGT"), F.col("allele")), F.lit(0)), F.lit(9))
    letters = cells.select("marker", F.explode(F.split("call", "")).alias("allele")).filter("allele <> ''")
    alleles = letters.groupBy("marker").agg(F.array_sort(F.collect_set(F.struct(order.alias("rank"), "allele"))).alias("a")).select("marker", F.transform("a", lambda x: x["allele"]).alias("alleles"))
    if by_allele:
        rows = cells.join(alleles, "marker").select("id", "marker", "call", F.explode("alleles").alias("allele"))
        return rows.select("id", "marker", "allele", F.when(F.col("call").isNotNull(), F.contains("call", "allele").cast("int")).alias("present"))
    if references is not None:
        kept = references.select("marker", "Alt", "Ref")
        counted: Column = F.length("call") - F.length(F.replace("call", F.col("Ref"), F.lit("")))
    else:
        kept = alleles.filter(F.size("alleles") <= 2) if multi else alleles
        kept = kept.select("marker", F.get("alleles", F.lit(1)).alias("Alt"), F.col("alleles")[0].alias("Ref"))
        counted = F.lit(ploidy) - (F.length("call") - F.length(F.replace("call", F.col("Ref"), F.lit(""))))
    rows = cells.join(kept, "marker").select("id", "marker", counted.cast("int").alias("dosage"), "Alt", "Ref")
    stats = rows.groupBy("marker").agg((F.avg("dosage") / ploidy).alias("_p"), F.mode("dosage", True).alias("_mode"))
    stats = stats.filter(F.col("_p").isNotNull() & (F.least(F.col("_p"), 1 - F.col("_p")) >= maf))
    out = rows.join(stats, "marker")
    return out.select("id", "marker", (F.coalesce("dosage", "_mode") if imp else F.col("dosage")).alias("dosage"), "Alt", "Ref")


def to_letters(dosages: DataFrame, references: DataFrame, ploidy: int = 2) -> DataFrame:
    """Calls from dosages (id, marker, dosage) and (marker, Alt, Ref): the Alt letter as often as Ref is absent, then Ref."""
    rows = dosages.join(references.select("marker", "Alt", "Ref"), "marker")
    d = F.col("dosage").cast("int")
    call = F.concat(F.call_function("repeat", F.coalesce(F.col("Alt"), F.lit("")), F.abs(d - ploidy)), F.call_function("repeat", F.coalesce(F.col("Ref"), F.lit("")), d))
    return rows.select("id", "marker", call.alias("call"))


def build_hybrids(first: DataFrame, second: DataFrame, crosses: DataFrame | None = None, separator: str = ":") -> DataFrame:
    """Additive and dominance codes of hybrids of two sets of lines (id, marker, dosage): (hybrid, marker, additive, dominance).

    Dosages are {0, 1}, {0, 2} or {-1, 1}, recoded to {-1, 1}; other values are refused as nulls would hide them. Without
    ``crosses`` (Var1, Var2, hybrid) every line of one set meets every line of the other, each unordered pair once. The
    crosses meet marker by marker: an equi-join, whose rows are the result's.
    """
    def coded(df: DataFrame, tag: str) -> DataFrame:
        low, high = df.agg(F.min("dosage"), F.max("dosage")).first()
        if (low, high) not in ((0, 1), (0, 2), (-1, 1)) or df.filter(~F.col("dosage").isin(low, high)).limit(1).count():
            raise ValueError(f"lines are coded 0/1, 0/2 or -1/1, not {low}..{high}")
        return df.select(F.col("id").alias(tag), "marker", (F.when(F.col("dosage") == high, 1.0).otherwise(-1.0)).alias(f"x_{tag}"))

    a, b = coded(first, "Var1"), coded(second, "Var2")
    if crosses is None:
        # of a cross and its reverse, possible where a line is in both sets, the one with the smaller line first stays
        twice = first.select(F.col("id").alias("l")).distinct().intersect(second.select(F.col("id").alias("l")).distinct()).withColumn("both", F.lit(True))
        known = lambda df, tag: df.join(twice.select(F.col("l").alias(tag), F.col("both").alias(f"in_{tag}")), tag, "left")
        rows = known(a, "Var1").join(known(b, "Var2"), "marker").filter("in_Var1 is null or in_Var2 is null or Var1 <= Var2")
        rows = rows.withColumn("hybrid", F.concat_ws(separator, F.col("Var1"), F.col("Var2")))
    else:
        rows = crosses.select("Var1", "Var2", "hybrid").join(a, "Var1").join(b, ["Var2", "marker"])
    return rows.select("hybrid", "marker", ((F.col("x_Var1") + F.col("x_Var2")) / 2).alias("additive"), (0.5 * (1 - F.col("x_Var1") * F.col("x_Var2"))).alias("dominance"))


def _placed(markers: DataFrame, positions: DataFrame) -> DataFrame:
    """Cells of markers that vary and have a place; a locus given twice keeps its smallest (LG, Position)."""
    place = positions.filter("LG is not null").groupBy(F.col("Locus").alias("marker")).agg(F.min(F.struct("LG", "Position")).alias("at")).select("marker", "at.LG", "at.Position")
    varies = markers.groupBy("marker").agg(F.var_samp("dosage").alias("v")).filter("v > 0").select("marker")
    return markers.join(varies, "marker", "left_semi").join(place, "marker")


def _tail(r2: Column, n: Column) -> Column:
    """Upper tail of chi-squared with one degree of freedom at n r2, through the complementary error function's series.

    Abramowitz and Stegun 7.1.26 in column form; its error is under 1.5e-7.
    """
    x = F.sqrt(n * r2 / 2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def ld_decay(markers: DataFrame, positions: DataFrame) -> DataFrame:
    """Within linkage groups, each pair of markers: distance d, squared correlation r2 over individuals that have both, p.

    Pairs meet through their individuals (an equi-join on group and individual), so a pair's sums are combined map-side.
    """
    cells = _placed(markers, positions).select("LG", "id", "marker", "Position", F.col("dosage").cast("double").alias("x")).filter("x is not null")
    total = markers.agg(F.count_distinct("id").alias("n_ids"))
    a, b = (cells.select("LG", "id", F.col("marker").alias(f"marker{k}"), F.col("Position").alias(f"p{k}"), F.col("x").alias(f"x{k}")) for k in (1, 2))
    pairs = a.join(b, ["LG", "id"]).filter("p1 < p2 or (p1 = p2 and marker1 <= marker2)")
    out = pairs.groupBy("LG", "marker1", "marker2", F.abs(F.col("p1") - F.col("p2")).alias("d")).agg(F.pow(F.corr("x1", "x2"), 2).alias("r2"))
    out = out.filter(~((F.col("d") == 0) & (F.col("r2") == 0))).crossJoin(F.broadcast(total))  # one row
    return out.select("LG", "marker1", "marker2", "d", "r2", _tail(F.col("r2"), F.col("n_ids")).alias("p"))


def ld_unlinked(markers: DataFrame, positions: DataFrame, gamma: float = 0.95) -> DataFrame:
    """Per linkage group the squared gamma-quantile of absolute correlations with markers of all other groups: (LG, r2)."""
    cells = _placed(markers, positions).select("LG", "id", "marker", F.col("dosage").cast("double").alias("x")).filter("x is not null")
    a, b = (cells.select("id", F.col("LG").alias(f"LG{k}"), F.col("marker").alias(f"marker{k}"), F.col("x").alias(f"x{k}")) for k in (1, 2))
    each = a.join(b, "id").filter("LG1 < LG2").groupBy("LG1", "marker1", "LG2", "marker2").agg(F.abs(F.corr("x1", "x2")).alias("r"))
    both = each.select(F.explode(F.array("LG1", "LG2")).alias("LG"), "r")
    return both.groupBy("LG").agg(F.pow(F.percentile("r", gamma), 2).alias("r2"))


def ne_marker(markers: DataFrame, sizes: Sequence[int] = tuple(range(10, 101, 10)), samples: int = 5, max_marker: int = 1000, seed: int = 1) -> DataFrame:
    """Share of the population's alleles that samples of n individuals hold: (ne, allele_mean, allele_sd) over seeded samples.

    Markers beyond ``max_marker`` are left out by a seeded hash: sampling is what this operator does.
    """
    chosen = markers.select("marker").distinct().orderBy(F.md5(F.concat_ws("/", "marker", F.lit(seed))), "marker").limit(max_marker)
    alleles = markers.join(chosen, "marker", "left_semi").select("id", "marker", F.explode(F.expr("case when dosage = 0 then array(0, 1) when dosage < 0 then array(0) when dosage > 0 then array(1) else array() end")).alias("allele"))
    total = alleles.select("marker", "allele").distinct().count()
    draws = markers.select("id").distinct().select("id", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("draw"))
    order = Window.partitionBy("draw").orderBy(F.md5(F.concat_ws("/", "id", "draw", F.lit(seed))), "id")
    ranked = draws.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= max(sizes))
    first = alleles.join(ranked, "id").groupBy("draw", "marker", "allele").agg(F.min("k").alias("k"))
    held = [F.sum((F.col("k") <= n).cast("long")).alias(str(n)) for n in sizes]
    long = first.groupBy("draw").agg(*held).unpivot(["draw"], [str(n) for n in sizes], "ne", "held")
    return long.groupBy(F.col("ne").cast("int").alias("ne")).agg(F.avg(F.col("held") / total).alias("allele_mean"), F.stddev_samp(F.col("held") / total).alias("allele_sd"))


def two_way_imputation(cells: DataFrame, similarity: DataFrame, nearest: int = 10, rounded: bool = False) -> DataFrame:
    """Fills a table in long form (row, col, value): (row, col, value, imputed, estimate).

    Estimate: in each column the mean over the ``nearest`` rows with data that are most similar in absolute value, of
    those positively related (``similarity``: row, col, value). Then in each row the observed values are regressed on
    their estimates, and the line fills the gaps; what is still empty gets the grand mean.
    """
    grand = cells.agg(F.avg("value").alias("_grand"))
    observed = cells.filter("value is not null").select(F.col("row").alias("other"), "col", F.col("value").alias("seen"))
    related = similarity.select(F.col("row"), F.col("col").alias("other"), F.col("value").alias("s"))
    # the n most similar rows with data: candidates are the pairs of the similarity table, ranked within (row, col)
    ranked = related.join(observed, "other").withColumn("k", F.row_number().over(Window.partitionBy("row", "col").orderBy(F.desc(F.abs("s")), "other"))).filter(F.col("k") <= nearest)
    estimate = ranked.groupBy("row", "col").agg(F.avg(F.when(F.col("s") > 0, F.col("seen"))).alias("estimate"))
    both = cells.join(estimate, ["row", "col"], "left")
    lines = both.groupBy("row").agg(F.regr_slope("value", "estimate").alias("_b"), F.regr_intercept("value", "estimate").alias("_a"))
    out = both.join(lines, "row").crossJoin(F.broadcast(grand))  # one row
    line = F.col("_a") + F.col("_b") * F.col("estimate")
    rnd = (lambda x: F.round(x)) if rounded else (lambda x: x)
    return out.select("row", "col", "value", F.coalesce("value", rnd(line), "_grand").alias("imputed"), F.coalesce(rnd(F.col("estimate")), "_grand").alias("estimate"))
