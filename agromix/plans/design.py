"""Design matrices as columns of sparse entries, and their distributed cross-products.

Each record carries an array of (index, value) pairs, one or a few for each term. Levels get their index by a broadcast
join with the term's dictionary, which is bounded by MAX_ORDER and checked; one job finds the dictionaries of all terms.
W' R^-1 W is kept apart by residual level, so one Spark job serves a whole fit. A few covariates alone are plain sums of
products; designs without covariates are first collapsed to distinct rows; others are summed by blocks of records in
each task. Only these sums, coefficients squared at most, come to the driver.

In names of interactions, levels are joined by colons; colons and backslashes within a level get a backslash before them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from agromix.operators.matrices import MAX_ORDER, dense
from agromix.plans.formula import Call, Interaction, Name

__all__ = ["Design", "Gram", "RandomTerm", "TooManyLevels", "assembled", "build_design", "gram_cells", "gram_of", "join_levels", "joined_key", "split_level"]

#: Bytes of cross-products on the driver; covariates that are summed as plain columns; widest dense block of a task.
DRIVER_BYTES, PLAIN, DENSE = 4 << 30, 16, 512

ENTRY = "array<struct<i:int,v:double>>"


class TooManyLevels(ValueError):
    """Coefficients whose cross-products would not fit the driver."""


STRUCTURES = {"isc", "dsc", "usc", "csc", "atc", "isr", "dsr", "usr", "csr", "atr"}


@dataclass
class Block:
    """A set of coefficients: where it starts, the names of its columns."""

    label: str
    start: int
    names: list[str]
    variables: tuple[str, ...] = ()

    @property
    def size(self) -> int:
        return len(self.names)


@dataclass
class RandomTerm(Block):
    """Coefficients ordered inner level by main level, with covariance theta (inner) Kronecker kernel (main)."""

    inner: list[str] = field(default_factory=list)
    main: list[str] = field(default_factory=list)
    theta: np.ndarray = field(default_factory=lambda: np.eye(1))
    codes: np.ndarray = field(default_factory=lambda: np.ones((1, 1), int))
    kernel_inverse: np.ndarray | None = None
    kernel_logdet: float = 0.0


@dataclass
class Design:
    rows: DataFrame
    fixed: list[Block]
    random: list[RandomTerm]
    levels: list[str]
    numeric: bool
    plain: list[Column] | None = None

    @property
    def width(self) -> int:
        return sum(b.size for b in (*self.fixed, *self.random))


@dataclass
class Gram:
    """By residual level: [X Z y]' diag(w) [X Z y], records, and the sum of log weights."""

    sums: dict[str, np.ndarray]
    records: dict[str, int]
    log_weights: dict[str, float]


def joined_key(names: list[str]) -> Column:
    """The level of an interaction, null where a factor is."""
    keys = [F.col(n).cast("string") for n in names]
    if len(keys) == 1:
        return keys[0]
    escaped = [F.regexp_replace(k, r"([:\\])", r"\\$1") for k in keys]
    return F.when(F.forall(F.array(*keys), lambda x: x.isNotNull()), F.concat_ws(":", *escaped))


def join_levels(levels: list[str] | tuple[str, ...]) -> str:
    """The name of an interaction's level."""
    return ":".join(re.sub(r"([:\\])", r"\\\1", x) for x in levels) if len(levels) > 1 else levels[0]


def split_level(name: str) -> list[str]:
    """The levels that the name of an interaction's level joins."""
    return [re.sub(r"\\(.)", r"\1", x) for x in re.findall(r"(?:[^:\\]|\\.)+|(?<=:)(?=:|$)|^(?=:)", name)]


class _Encoder:
    """Adds to a DataFrame, for each request, a column of entries within one effect; collects the names of its columns."""

    def __init__(self, df: DataFrame, covariances: dict):
        self.df, self.covariances, self.made, self.numeric = df, covariances, 0, False
        self.known: dict[str, list[str]] = {}
        self.widths: dict[str, int] = {}
        self.plain: list[Column] | None = []  # the value of each coefficient, as long as none is a factor's

    def _is_numeric(self, name: str) -> bool:
        if name not in self.df.columns:
            raise ValueError(f"no column {name}")
        return isinstance(self.df.schema[name].dataType, NumericType)

    def keys_of(self, term) -> dict[str, Column]:
        """The factors and interactions whose levels a term needs, by name."""
        if isinstance(term, Call):
            if term.name in ("leg", "basis"):
                return {}
            if term.name == "overlay":
                return {str(a): F.col(str(a)).cast("string") for a in term.args}
            some = term.args[:1] if term.name in ("rrc", "redmm", "atc", "atr", "csc", "csr") else term.args
            return {k: v for a in some for k, v in self.keys_of(a).items()}
        names = [p.name for p in self.parts(term) if isinstance(p, Name) and p.name in self.df.columns and not self._is_numeric(p.name)]
        return {str(term): joined_key(names)} if names else {}

    def find_levels(self, keys: dict[str, Column]) -> None:
        """The dictionaries of all terms in one job; each is bounded, so the sum is."""
        if not keys:
            return
        names = list(keys)
        most = len(names) * (MAX_ORDER + 1)
        cells = self.df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("t"), keys[n].alias("k")) for i, n in enumerate(names)))))
        found = cells.filter("k is not null").distinct().limit(most).collect()
        for i, n in enumerate(names):
            own = sorted(r["k"] for r in found if r["t"] == i)
            if len(own) > MAX_ORDER or len(found) == most:
                over = n if len(own) > MAX_ORDER else " or ".join(names)
                raise TooManyLevels(f"{over} has over {MAX_ORDER} levels; their cross-products would not fit the driver")
            self.known[n] = own

    def find_widths(self, terms: tuple) -> None:
        """The widths of all array columns that terms name as basis(), in one job."""
        names: list[str] = []

        def seek(x) -> None:
            if isinstance(x, Call) and x.name == "basis" and str(x.args[0]) in self.df.columns:
                names.append(str(x.args[0]))
            for y in (*getattr(x, "args", ()), *getattr(x, "parts", ())):
                seek(y)

        for term in terms:
            seek(term)
        names = list(dict.fromkeys(names))
        if names:
            found = self.df.agg(*(F.max(F.size(n)) for n in names)).first()
            self.widths = {n: w or 0 for n, w in zip(names, found, strict=True)}

    def _levels(self, key: Column, what: str) -> list[str]:
        if what in self.known:
            return list(self.known[what])
        found = [r[0] for r in self.df.select(key.alias("k")).filter("k is not null").distinct().limit(MAX_ORDER + 1).collect()]
        if len(found) > MAX_ORDER:
            raise TooManyLevels(f"{what} has over {MAX_ORDER} levels; their cross-products would not fit the driver")
        return sorted(found)

    def _lookup(self, key: Column, table: dict[str, list[tuple[int, float]]]) -> Column:
        self.made += 1
        k, e = f"_k{self.made}", f"_e{self.made}"
        rows = [(level, [(int(i), float(v)) for i, v in cells]) for level, cells in table.items()]
        small = self.df.sparkSession.createDataFrame(rows, f"{k} string, {e} {ENTRY}")
        self.df = self.df.withColumn(f"_s{self.made}", key).join(F.broadcast(small), F.col(f"_s{self.made}") == F.col(k), "left").drop(k, f"_s{self.made}")
        return F.coalesce(F.col(e), F.array().cast(ENTRY))

    def parts(self, term) -> list:
        return list(term.parts) if isinstance(term, Interaction) else [term]

    def _static(self, values: list[Column] | None) -> None:
        """Notes the values of the coefficients that are made now; one factor ends the list."""
        self.plain = None if values is None or self.plain is None else self.plain + values

    def columns(self, term, drop_first: bool = False, extra: list[str] | None = None, weights: Callable | None = None) -> tuple[Column, list[str]]:
        """(entries, names) of a main effect: a factor, covariate, interaction, overlay(...) or leg(...)."""
        if isinstance(term, Call) and term.name == "overlay":
            factors = [str(a) for a in term.args]
            keys = [F.col(f).cast("string") for f in factors]
            levels = sorted({x for k, f in zip(keys, factors, strict=True) for x in self._levels(k, f)} | set(extra or ()))
            found = [self._lookup(k, {x: [(i, 1.0)] for i, x in enumerate(levels)}) for k in keys]
            self._static(None)
            return F.concat(*found), levels
        if isinstance(term, Call) and term.name == "leg":
            self.numeric = True
            x, n = str(term.args[0]), int(term.args[1].value) if len(term.args) > 1 else 1
            number = lambda k, d: float(getattr(term.named[k], "value", str(term.named[k]))) if k in term.named else d
            truth = lambda k, d: str(term.named[k]).upper() in ("TRUE", "T", "1") if k in term.named else d
            first = 0 if truth("intercept", True) else 1
            from agromix.functions.numeric import legendre

            self.made += 1
            tag = f"_l{self.made}_"
            made = legendre(self.df, x, n, number("u", -1.0), number("v", 1.0), first == 0, truth("intercept1", False))
            self.df = made.withColumnsRenamed({f"leg{k}": f"{tag}{k}" for k in range(first, n + 1)})
            self._static([F.col(f"{tag}{k}") for k in range(first, n + 1)])
            return F.array(*(F.struct(F.lit(k - first).alias("i"), F.col(f"{tag}{k}").alias("v")) for k in range(first, n + 1))), [f"leg{k}" for k in range(first, n + 1)]
        if isinstance(term, Call) and term.name == "basis":  # an array column, one coefficient for each place
            self.numeric = True
            name = str(term.args[0])
            if name not in self.df.columns:
                raise ValueError(f"no column {name}")
            width = self.widths[name] if name in self.widths else self.df.agg(F.max(F.size(name))).first()[0] or 0
            if width > MAX_ORDER:
                raise ValueError(f"{name} has over {MAX_ORDER} columns")
            self._static([F.coalesce(F.get(F.col(name), F.lit(k)).cast("double"), F.lit(0.0)) for k in range(width)])
            return F.transform(F.col(name).cast("array<double>"), lambda v, i: F.struct(i.alias("i"), v.alias("v"))), [f"{name}{k + 1}" for k in range(width)]
        if isinstance(term, Call) and term.name in ("rrc", "redmm"):
            self.numeric = True
            x, loads = str(term.args[0]), self.covariances[str(term.args[1])]
            levels, gamma = loads
            names = [f"PC{j + 1}" for j in range(gamma.shape[1])]
            self._static(None)
            missing = set(self._levels(F.col(x).cast("string"), x)) - set(levels)
            if missing:
                raise ValueError(f"{term}: no loadings for {sorted(missing)[:3]}")
            return self._lookup(F.col(x).cast("string"), {lev: [(j, gamma[i, j]) for j in range(gamma.shape[1])] for i, lev in enumerate(levels)}), names
        names, value = [], F.lit(1.0)
        for part in self.parts(term):
            if not isinstance(part, Name):
                raise ValueError(f"cannot use {part} as an effect")
            if self._is_numeric(part.name):
                self.numeric = True
                value = value * F.col(part.name).cast("double")
            else:
                names.append(part.name)
        if not names:
            self._static([value])
            return F.array(F.struct(F.lit(0).alias("i"), value.alias("v"))), [str(term)]
        self._static(None)
        key = joined_key(names)
        levels = sorted(set(self._levels(key, str(term))) | set(extra or ()))
        if drop_first:
            levels = levels[1:]
        found = self._lookup(key, {x: [(i, 1.0)] for i, x in enumerate(levels)})
        return F.transform(found, lambda e: F.struct(e["i"].alias("i"), (e["v"] * value).alias("v"))), levels


def _shift(entries: Column, by: int) -> Column:
    return F.transform(entries, lambda e: F.struct((e["i"] + by).cast("int").alias("i"), e["v"].alias("v")))


def _bare(term):
    """The effect inside isc() and vsc()."""
    while isinstance(term, Call) and term.name in ("isc", "isr", "vsc", "vsr", "vs"):
        term = term.args[-1]
    return term


def _product(outer: Column, inner: Column, width: int) -> Column:
    """Entries of the row-wise Kronecker product of two sets of entries, the second ``width`` wide."""
    return F.flatten(F.transform(outer, lambda e: F.transform(inner, lambda m: F.struct((e["i"] * width + m["i"]).cast("int").alias("i"), (e["v"] * m["v"]).alias("v")))))


def _structure(encoder: _Encoder, call: Call) -> tuple[Column, list[str], str]:
    """(entries, levels, kind) of an inner structure. atc() drops the levels that it doesn't name; atr() keeps them, without variance."""
    kind = call.name.rstrip("rc") if call.name in STRUCTURES else None
    if kind is None:
        raise ValueError(f"{call.name} is not a covariance structure")
    arg = call.args[0]
    if kind == "at":
        entries, levels = encoder.columns(arg)
        wanted = [str(a).strip("'\"") for a in call.args[1:]] or levels
        unknown = set(wanted) - set(levels)
        if unknown:
            raise ValueError(f"{call}: unknown levels {sorted(unknown)}")
        if call.name == "atr":
            return entries, levels, "d"
        places = {levels.index(x): k for k, x in enumerate(wanted)}
        moved = F.transform(F.filter(entries, lambda e: e["i"].isin(list(places))), lambda e: F.struct(F.element_at(F.create_map(*(F.lit(z) for kv in places.items() for z in kv)), e["i"]).alias("i"), e["v"].alias("v")))
        return moved, wanted, "d"
    entries, levels = encoder.columns(arg)
    return entries, levels, {"is": "i", "ds": "d", "us": "u", "cs": "c"}[kind]


def _kernel(encoder: _Encoder, main, kernel: DataFrame) -> tuple[list[str], np.ndarray]:
    """A kernel on the driver. One of more than MAX_ORDER levels is cut to those of the records.

    Levels without records don't change the likelihood; extended_blups() gives their effects.
    """
    names = kernel.select(F.col("row").cast("string").alias("l")).distinct()
    if names.limit(MAX_ORDER + 1).count() <= MAX_ORDER:
        return dense(kernel)
    seen = sorted({x for what, key in encoder.keys_of(main).items() for x in encoder._levels(key, what)})
    small = F.broadcast(kernel.sparkSession.createDataFrame([(x,) for x in seen], "l string"))  # MAX_ORDER levels at most
    cut = kernel.join(small, F.col("row").cast("string") == F.col("l"), "left_semi").join(small, F.col("col").cast("string") == F.col("l"), "left_semi")
    return dense(cut, seen)


def build_design(df: DataFrame, response: str, fixed: tuple, intercept: bool, random: tuple, residual: str | None = None, weights: str | None = None, kernels: dict | None = None, covariances: dict | None = None, apart: bool = False) -> Design:
    """The design of a one-response model. ``kernels``: name -> (row, col, value) covariance; ``covariances``: name -> (levels, loadings) or a constraint matrix.

    ``apart``: the residual levels, any number of them, are only for gram_cells() and stay where they are; none is listed.
    """
    encoder = _Encoder(df, covariances or {})
    level = F.col(residual).cast("string") if residual else F.lit("units")
    wanted = {k: v for t in (*fixed, *random) for k, v in encoder.keys_of(t).items()}
    encoder.find_levels(wanted | ({"the residual": level} if residual and not apart else {}))
    encoder.find_widths((*fixed, *random))
    at, entries = 0, []
    blocks: list[Block] = []
    terms: list[RandomTerm] = []
    if intercept:
        blocks.append(Block("(Intercept)", 0, ["(Intercept)"]))
        entries.append(F.array(F.struct(F.lit(0).alias("i"), F.lit(1.0).alias("v"))))
        encoder._static([F.lit(1.0)])
        at = 1
    contrast = intercept
    for t in fixed:
        factor = isinstance(t, Name) and not encoder._is_numeric(t.name)
        cells, names = encoder.columns(t, drop_first=factor and contrast)
        contrast = contrast or factor
        entries.append(_shift(cells, at))
        blocks.append(Block(str(t), at, names, tuple(str(p) for p in encoder.parts(t))))
        at += len(names)
    for t in random:
        gu, thetas, codes = None, None, None
        if isinstance(t, Call) and t.name in ("vsc", "vsr", "vs"):
            *inner, main = t.args
            gu = str(t.named["Gu"]) if "Gu" in t.named else None
            main = _bare(main)
            found = [_structure(encoder, c) for c in inner]
        elif isinstance(t, Call) and t.name in ("covc", "gvsr"):
            if len(t.args) < 2 or (t.name == "covc" and len(t.args) != 2):
                raise ValueError("covc joins two effects, gvsr two or more")
            main, found = t, []
        else:
            main, found = t, []
        kernel_levels, kernel = _kernel(encoder, main, kernels[gu]) if gu else (None, None)
        if isinstance(main, Call) and main.name in ("covc", "gvsr"):
            sides = [_bare(x) for x in main.args]
            gu = next((str(x.named["Gu"]) for x in (main, *main.args) if isinstance(x, Call) and "Gu" in x.named), None)
            kernel_levels, kernel = _kernel(encoder, Call("overlay", tuple(sides)), kernels[gu]) if gu else (None, None)
            union = sorted({x for s in sides for x in encoder._levels(F.col(str(s)).cast("string"), str(s))} | set(kernel_levels or ()))
            parts = [encoder.columns(s, extra=union)[0] for s in sides]
            q, labels, kind = len(union), [str(s) for s in sides], "u"
            cells = F.concat(*(_shift(p, k * q) for k, p in enumerate(parts)))
            main_names = union
        else:
            main_cells, main_names = encoder.columns(main, extra=kernel_levels)
            q, kind, labels = len(main_names), "i", [str(main)]
            cells = main_cells
            for inner_cells, levels, one in reversed(found):
                width = q * (len(labels) if cells is not main_cells else 1)
                labels = [f"{a}:{b}" if cells is not main_cells else a for a in levels for b in (labels if cells is not main_cells else [""])]
                cells = _product(inner_cells, cells, width)
                encoder._static(None)
                kind = one if kind == "i" else "u" if "u" in (kind, one) else kind
        if kernel_levels is not None and list(main_names) != list(kernel_levels):
            raise ValueError(f"levels of {main} that the kernel {gu} lacks: {sorted(set(main_names) - set(kernel_levels))[:3]}")
        size = len(labels)
        guc = str(t.named["Guc"]) if isinstance(t, Call) and "Guc" in t.named else None
        if guc:
            codes = np.asarray((covariances or {})[guc], int)
            if codes.shape != (size, size):
                raise ValueError(f"{guc} is not {size} x {size}")
            theta = np.where(codes > 0, 0.1, 0.0) + 0.05 * np.eye(size) * (np.diag(codes) > 0)
        elif kind == "u":
            theta, codes = 0.1 * np.ones((size, size)) + 0.05 * np.eye(size), np.where(np.eye(size, dtype=bool), 1, 2)
        elif kind == "c":
            custom = (covariances or {})[str(next(c for c in t.args if isinstance(c, Call) and c.name in ("csc", "csr")).args[1])]
            codes = np.asarray(custom, int)
            theta = np.where(codes > 0, 0.1, 0.0) + 0.05 * np.eye(size) * (np.diag(codes) > 0)
        elif kind == "i" and found:
            theta, codes = 0.15 * np.eye(size), np.eye(size, dtype=int)
        else:
            theta, codes = 0.15 * np.eye(size), np.eye(size, dtype=int)
        only = next((c for c in getattr(t, "args", ()) if isinstance(c, Call) and c.name == "atr" and len(c.args) > 1), None)
        if only is not None and len(found) == 1:
            codes = np.diag([int(x in {str(a).strip("'\"") for a in only.args[1:]}) for x in labels])
            theta = 0.15 * codes.astype(float)
        inverse, logdet = None, 0.0
        if kernel is not None:
            bend = 0.0 if np.linalg.eigvalsh(kernel)[0] > 1e-8 else 1e-6 * float(np.trace(kernel)) / len(kernel)
            kernel = kernel + bend * np.eye(len(kernel))
            inverse, logdet = np.linalg.inv(kernel), float(np.linalg.slogdet(kernel)[1])
        names = [f"{a}:{b}" if size > 1 else b for a in labels for b in main_names]
        variables = tuple(str(p) for p in encoder.parts(main)) if not isinstance(main, Call) else tuple(str(a) for a in main.args)
        terms.append(RandomTerm(str(t), at, names, variables, labels, list(main_names), theta, codes, inverse, logdet))
        entries.append(_shift(cells, at))
        at += len(names)
    if at > MAX_ORDER:
        raise TooManyLevels(f"{at} coefficients; over {MAX_ORDER} their cross-products would not fit the driver")
    rows = encoder.df.withColumns({"_entries": F.concat(*entries) if entries else F.array().cast(ENTRY), "_y": F.col(response).cast("double"), "_w": F.col(weights).cast("double") if weights else F.lit(1.0), "_level": level})
    levels = [] if apart else encoder.known["the residual"] if residual else ["units"]
    if 8 * len(levels) * (at + 1) ** 2 > DRIVER_BYTES:
        raise ValueError(f"{len(levels)} residual levels of {at} coefficients; their cross-products would not fit the driver")
    return Design(rows, blocks, terms, levels, encoder.numeric, encoder.plain)


def _partial(c: int):
    """Cross-products of what a task reads, by residual level: dense where that is small, by pairs of entries elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense_: dict[str, np.ndarray] = {}
        sparse: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        counts: dict[str, np.ndarray] = {}

        def add(level: str, row: np.ndarray, i: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> None:
            if c < DENSE:
                x = np.zeros((n, c + 1))
                np.add.at(x, (row, i), v)
                total = dense_.setdefault(level, np.zeros((c + 1, c + 1)))
                total += (x * w[:, None]).T @ x
                return
            order = np.argsort(row, kind="stable")
            row, i, v = row[order], i[order], v[order]
            sizes = np.bincount(row, minlength=n)
            begin = np.cumsum(sizes) - sizes
            left = np.repeat(np.arange(len(row)), sizes[row])  # every entry meets every entry of its record
            right = np.repeat(begin[row] - (np.cumsum(sizes[row]) - sizes[row]), sizes[row]) + np.arange(len(left))
            up = i[left] <= i[right]
            left, right = left[up], right[up]
            keys, where = np.unique(i[left].astype(np.int64) * (c + 1) + i[right], return_inverse=True)
            held = sparse.setdefault(level, [])
            held.append((keys, np.bincount(where, v[left] * v[right] * w[row[left]])))
            if sum(len(k) for k, _ in held) > 4_000_000:
                sparse[level] = [merged(held)]

        def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([v for _, v in held]))

        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                entries = batch.column(0)
                at = entries.offsets.to_numpy()
                i = entries.values.field("i").to_numpy(zero_copy_only=False)[at[0] : at[-1]]
                v = entries.values.field("v").to_numpy(zero_copy_only=False)[at[0] : at[-1]]
                row = np.repeat(np.arange(batch.num_rows), np.diff(at))
                y, w = (batch.column(n).to_numpy(zero_copy_only=False) for n in (1, 2))
                codes = batch.column(3).dictionary_encode()
                level_of = codes.indices.to_numpy()
                for one, level in enumerate(codes.dictionary.to_pylist()):
                    own = np.flatnonzero(level_of == one)
                    new = np.full(batch.num_rows, -1)
                    new[own] = np.arange(len(own))
                    here = new[row] >= 0
                    add(level, np.concatenate((new[row[here]], np.arange(len(own)))), np.concatenate((i[here], np.full(len(own), c))), np.concatenate((v[here], y[own])), w[own], len(own))
                    counts[level] = counts.get(level, np.zeros(2)) + (len(own), np.log(w[own]).sum())
        for level, (n, lw) in counts.items():
            if level in dense_:
                i, j = np.nonzero(np.triu(dense_[level]))
                v = dense_[level][i, j]
            else:
                keys, v = merged(sparse[level])
                i, j = keys // (c + 1), keys % (c + 1)
            i, j, v = np.append(i, (-1, -2)), np.append(j, (-1, -2)), np.append(v, (n, lw))
            for k in range(0, len(i), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([level] * len(i[part])), pa.array(i[part], pa.int32()), pa.array(j[part], pa.int32()), pa.array(v[part], pa.float64())], names=["_level", "i", "j", "v"])

    return run


def gram_of(design: Design) -> Gram:
    """All cross-products by one grouped sum."""
    c = design.width
    plain = getattr(design, "plain", None)
    out = Gram({x: np.zeros((c + 1, c + 1)) for x in design.levels}, dict.fromkeys(design.levels, 0), dict.fromkeys(design.levels, 0.0))
    w, y = F.col("_w"), F.col("_y")
    if plain is not None and len(plain) == c <= PLAIN:
        values = [*plain, y]
        pairs = [(i, j) for j in range(c + 1) for i in range(j + 1)]
        found = design.rows.filter("_y is not null").groupBy("_level").agg(F.count("*").alias("n"), F.sum(F.log("_w")).alias("lw"), *(F.sum(w * values[i] * values[j]).alias(f"s{i}_{j}") for i, j in pairs)).collect()
        for r in found:
            out.records[r["_level"]], out.log_weights[r["_level"]] = int(r["n"]), float(r["lw"] or 0.0)
            for i, j in pairs:
                out.sums[r["_level"]][i, j] = out.sums[r["_level"]][j, i] = r[f"s{i}_{j}"]
        return out
    found = gram_cells(design).toArrow()
    i, j, v = (found.column(x).to_numpy() for x in ("i", "j", "v"))
    level_of = np.array(found.column("_level").to_pylist(), dtype=object)
    for level in design.levels:
        own = level_of == level
        out.sums[level], out.records[level], out.log_weights[level] = assembled(c, i[own], j[own], v[own])
    return out


def assembled(c: int, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, int, float]:
    """(cross-products, records, sum of log weights) of one residual level from its cells."""
    sums, cell = np.zeros((c + 1, c + 1)), i >= 0
    sums[i[cell], j[cell]] = v[cell]
    sums[j[cell], i[cell]] = v[cell]
    return sums, int(v[i == -1].sum()), float(np.nan_to_num(v[i == -2]).sum())


def gram_cells(design: Design) -> DataFrame:
    """(_level, i, j, v): the cross-products by residual level as rows; -1 and -2 stand for the records and the sum of log weights."""
    c, w, y = design.width, F.col("_w"), F.col("_y")
    rows = design.rows.filter("_y is not null").select("_entries", "_y", "_w", "_level")
    if design.numeric:
        cells = rows.mapInArrow(_partial(c), "_level string, i int, j int, v double")
    else:
        cells = rows.groupBy("_entries", "_level").agg(F.count("*").alias("n"), F.sum(w).alias("s"), F.sum(w * y).alias("sy"), F.sum(w * y * y).alias("syy"), F.sum(F.log("_w")).alias("lw"))
        own = F.flatten(F.transform("_entries", lambda a: F.transform(F.filter("_entries", lambda b: b["i"] >= a["i"]), lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (F.col("s") * a["v"] * b["v"]).alias("v")))))
        right = F.transform("_entries", lambda a: F.struct(a["i"].alias("i"), F.lit(c).alias("j"), (F.col("sy") * a["v"]).alias("v")))
        corner = F.array(F.struct(F.lit(c).alias("i"), F.lit(c).alias("j"), F.col("syy").alias("v")), F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.col("n").cast("double").alias("v")), F.struct(F.lit(-2).alias("i"), F.lit(-2).alias("j"), F.col("lw").alias("v")))
        cells = cells.select("_level", F.inline(F.concat(own, right, corner)))
    return cells.groupBy("_level", "i", "j").agg(F.sum("v").alias("v"))
