"""Dense fields of any number of dimensions stored as chunks, reduced at all scales where they lie.

A chunk holds the values of one box as an array for each field, row by row, of ``MAX_CHUNK_BYTES`` at most.  The kernel works on Arrow batches
with NumPy along the plan: it reduces a chunk to pieces of blocks, and pieces of coarse blocks are merged from those of
finer ones.  A scale whose blocks don't cross chunks is finished in the task, without a shuffle; of other scales only the
pieces' states are exchanged, and merged by the counts that they hold.  All statistics of the library but
medians and users' own are in the kernel, for one field or two.

Windows need cells of the next chunks along each dimension: only the first window - 1 cells of a chunk
travel, to the chunks before it (round the ends, if periodic, and to one chunk further past a short last one).  A field that is stored as a bucketed table is joined with what
travels without a shuffle of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import MultiResResult, Scale, Sliding, Tower, plan_for
from .functions.statistics import Mean, Statistic, Var, minimal_components
from .operators.blocks import materialize
from .operators.merging import PREFIX, merged
from .operators.towers import SCALE
from .plans.lattice import Factor, factor_shape
from .plans.planner import ReductionPlan
from .sources.grid import Grid

#: Bytes of one field in a chunk, at most.
MAX_CHUNK_BYTES = 16 << 20
_SPREAD = {"m2": (0, 0), "m2_y": (1, 1), "c": (0, 1)}
_MEANS = {"mean": 0, "mean_y": 1}


@dataclass(frozen=True)
class Chunks:
    """``df`` has the chunk's place, BIGINT columns c0, c1, ..., and arrays v0 (and v1) of its values."""

    df: DataFrame
    dims: tuple[str, ...]
    extent: Factor
    shape: Factor
    arity: int = 1

    def __post_init__(self) -> None:
        if prod(self.shape) * 8 > MAX_CHUNK_BYTES:
            raise ValueError(f"a chunk of {self.shape} takes over {MAX_CHUNK_BYTES} bytes")

    @property
    def keys(self) -> list[str]:
        return [f"c{k}" for k in range(len(self.dims))]

    @classmethod
    def from_grid(cls, grid: Grid, shape: int | Sequence[int]) -> Chunks:
        """Chunks of a dense grid: its cells meet by chunk in one shuffle."""
        if not grid.dense:
            raise ValueError("chunks hold dense grids")
        shape = (shape,) * len(grid.dims) if isinstance(shape, int) else tuple(shape)
        at = F.lit(0).cast("long")
        for d, s in zip(grid.dims, shape, strict=True):
            at = at * s + F.col(d) % s
        keys = [F.expr(f"`{d}` div {s}").alias(f"c{k}") for k, (d, s) in enumerate(zip(grid.dims, shape, strict=True))]
        values = [F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(grid.values)]
        rows = grid.df.select(*keys, F.struct(at.alias("at"), *values).alias("cell"))
        sorted_ = rows.groupBy(*[f"c{k}" for k in range(len(shape))]).agg(F.sort_array(F.collect_list("cell")).alias("cells"))
        arrays = [F.col(f"cells.v{k}").alias(f"v{k}") for k in range(grid.arity)]
        return cls(sorted_.select(*[f"c{k}" for k in range(len(shape))], *arrays), grid.dims, grid.extent, shape, grid.arity)

    def stored(self, table: str, path: str, buckets: int = 8) -> Chunks:
        """The field as a table bucketed by chunk, so that windows shuffle only what travels."""
        spark = self.df.sparkSession
        self.df.write.mode("overwrite").option("path", path).bucketBy(buckets, *self.keys).sortBy(*self.keys).saveAsTable(table)
        return Chunks(spark.table(table), self.dims, self.extent, self.shape, self.arity)

    def reduce_stats(self, scales: Tower | Scale | Sequence[Scale], stats: Sequence[Statistic] = (Mean(), Var()), skipna: bool = False) -> MultiResResult:
        """Statistics of blocks at all scales; ``to_dataframe`` has them from one pass for scales that
        chunks hold whole, and one for the others."""
        components = self._checked(stats)
        plan = plan_for(self.extent, scales)
        inside = [k for k, s in enumerate(plan.steps) if all(c % f == 0 for c, f in zip(self.shape, s.factor, strict=True))]
        wanted = [k for k, s in enumerate(plan.steps) if s.wanted]
        parts = []
        here, across = [k for k in wanted if k in inside], [k for k in wanted if k not in inside]
        if here:
            parts.append(self._pieces(plan, here, components, skipna))
        if across:
            parts.append(merged(self._pieces(plan, across, components, skipna), [SCALE, *self.dims], components))
        rows = materialize(reduce(DataFrame.unionByName, parts), [SCALE, *self.dims], stats)
        of = [F.element_at(F.array(*[F.lit(s.factor[k]).cast("long") for s in plan.steps]), F.col(SCALE) + 1).alias(f"f_{d}") for k, d in enumerate(self.dims)]
        frames = {plan.steps[k].factor: rows.where(F.col(SCALE) == k).drop(SCALE) for k in wanted}
        return MultiResResult(self.dims, frames, {f: factor_shape(self.extent, f) for f in frames}, plan, together=rows.select(*of, *[c for c in rows.columns if c != SCALE]))

    def _checked(self, stats: Sequence[Statistic]) -> dict:
        components = minimal_components(stats)
        bad = [s.name for s in stats if s.arity != self.arity or not s.mergeable or any("__" in c.name for c in s.components())]
        if bad:
            raise ValueError(f"chunks of {self.arity} field(s) don't take {', '.join(bad)}")
        return components

    def _schema(self, components: dict) -> str:
        kinds = {"n": "long", "has_nan": "boolean"}
        return ", ".join([f"{SCALE} int", *[f"`{d}` long" for d in self.dims], *[f"`{PREFIX}{c}` {kinds.get(c, 'double')}" for c in components]])

    def _pieces(self, plan: ReductionPlan, wanted: Sequence[int], components: dict, skipna: bool) -> DataFrame:
        """The state of every chunk's pieces of the blocks of some steps."""
        needed: set[int] = set()
        for k in wanted:
            while k is not None and k not in needed:
                needed.add(k)
                k = plan.steps[k].source
        names, keys, shape, extent, arity, dims = list(components), self.keys, self.shape, self.extent, self.arity, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            for batch in batches:
                for r in range(batch.num_rows):
                    chunk = [batch.column(c)[r].as_py() for c in keys]
                    fields = _fields(np, batch, r, _box(chunk, shape, extent), arity)
                    made: dict[int, tuple[list, dict]] = {}
                    for k in sorted(needed):
                        step = plan.steps[k]
                        if step.source is None:
                            made[k] = _lifted(np, fields, [c * s for c, s in zip(chunk, shape, strict=True)], step.factor, extent, names, skipna)
                        else:
                            made[k] = _coarser(np, *made[step.source], step.window, [x // f for x, f in zip(extent, step.factor, strict=True)])
                        blocks, state = made[k]
                        if k in wanted and all(len(b) for b in blocks):
                            yield _batch(np, k, dims, blocks, state, names)

        return self.df.mapInArrow(run, self._schema(components))

    def sliding(self, spec: Sliding, stats: Sequence[Statistic] = (Mean(), Var()), periodic: bool = False, strict: bool = True) -> DataFrame:
        """Statistics of overlapping windows at their places k; periodic ones wrap round the ends, so one starts at every place.

        A window reaches no further than the next chunk in each dimension, or, in a periodic field whose last chunk is shorter,
        the one after it; ``strict`` takes periodic fields of whole chunks only."""
        components = self._checked(stats)
        window, stride, origin = spec.resolved(self.extent)
        if any(w - 1 > s for w, s in zip(window, self.shape, strict=True)):
            raise ValueError(f"windows of {window} reach over chunks of {self.shape}")
        if periodic and strict and any(x % s for x, s in zip(self.extent, self.shape, strict=True)):
            raise ValueError("a periodic field has whole chunks")
        counts = [(x - o - 1) // s + 1 if periodic else (x - w - o) // s + 1 for x, w, s, o in zip(self.extent, window, stride, origin, strict=True)]
        shape, extent, keys, arity, names, dims = self.shape, self.extent, self.keys, self.arity, list(components), self.dims
        n_chunks = [-(-x // s) for x, s in zip(extent, shape, strict=True)]
        # hops along each dimension: none, to the chunk before, and past a short last chunk to the one before that
        hops = [range(3 if periodic and m > 1 and (x - 1) % s + 1 < w - 1 else 2 if w > 1 else 1) for x, s, m, w in zip(extent, shape, n_chunks, window, strict=True)]
        sides = [side for side in product(*hops) if any(side)]

        def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What travels: the low cells of a chunk, to the chunk before it along the sides' dimensions."""
            import numpy as np

            for batch in batches:
                out: list[tuple] = []
                for r in range(batch.num_rows):
                    chunk = [batch.column(c)[r].as_py() for c in keys]
                    fields = _fields(np, batch, r, _box(chunk, shape, extent), arity)
                    for k, side in enumerate(sides):
                        to = [(c - b) % m if periodic else c - b for c, b, m in zip(chunk, side, n_chunks, strict=True)]
                        if min(to) >= 0:
                            spans = _spans(side, to, shape, extent, window, periodic)
                            if all(n for _, n in spans):
                                cut = tuple(slice(0, n) for _, n in spans)
                                out.append((*to, k, *[np.ascontiguousarray(x[cut]).ravel() for x in fields]))
                columns = list(zip(*out, strict=True)) or [()] * (len(keys) + 1 + arity)
                kinds = [pa.int64()] * len(keys) + [pa.int32()] + [pa.list_(pa.float64())] * arity
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[*keys, "side", *[f"v{k}" for k in range(arity)]])

        kinds = ", ".join([*[f"{c} long" for c in keys], "side int", *[f"v{k} array<double>" for k in range(arity)]])
        travels = self.df.mapInArrow(borders, kinds).groupBy(*keys).agg(F.collect_list(F.struct("side", *[f"v{k}" for k in range(arity)])).alias("borders"))
        met = self.df.join(travels, keys, "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            for batch in batches:
                for r in range(batch.num_rows):
                    chunk = [batch.column(c)[r].as_py() for c in keys]
                    own = _box(chunk, shape, extent)
                    wide = tuple(min(n + w - 1, n + (extent[d] if periodic else extent[d] - chunk[d] * shape[d] - n)) for d, (n, w) in enumerate(zip(own, window, strict=True)))
                    fields = [np.full(wide, np.nan) for _ in range(arity)]
                    inner = tuple(slice(0, n) for n in own)
                    for field, x in zip(fields, _fields(np, batch, r, own, arity), strict=True):
                        field[inner] = x
                    for border in batch.column("borders")[r].as_py() or ():
                        spans = _spans(sides[border["side"]], chunk, shape, extent, window, periodic)
                        at = tuple(slice(first, first + n) for first, n in spans)
                        for k, field in enumerate(fields):
                            field[at] = np.array(border[f"v{k}"]).reshape([n for _, n in spans])
                    made = _windows(np, fields, [c * s for c, s in zip(chunk, shape, strict=True)], own, window, stride, origin, counts, names)
                    if made is not None:
                        yield _batch(np, 0, dims, *made, names)

        return materialize(met.mapInArrow(run, self._schema(components)).drop(SCALE), self.dims, stats)


def _box(chunk: Sequence[int], shape: Factor, extent: Factor) -> Factor:
    """The shape of one chunk: those at the high end may be smaller."""
    return tuple(min(s, x - c * s) for c, s, x in zip(chunk, shape, extent, strict=True))


def _spans(side: Sequence[int], chunk: Sequence[int], shape: Factor, extent: Factor, window: Factor, periodic: bool) -> list[tuple[int, int]]:
    """Where what comes to a chunk from the chunk so many hops on lies behind it, in each dimension: (start, length)."""
    out = []
    for hop, c, s, x, w in zip(side, chunk, shape, extent, window, strict=True):
        m = -(-x // s)
        sizes = [min(s, x - k * s) for k in ((c + h) % m if periodic else c + h for h in range(hop + 1))]
        out.append((sum(sizes[:hop]), max(min(sizes[hop], w - 1 - sum(sizes[1:hop])), 0) if hop else sizes[0]))
    return out


def _fields(np, batch: pa.RecordBatch, r: int, box: Factor, arity: int) -> list:  # noqa: ANN001
    out = []
    for k in range(arity):
        x = np.asarray(batch.column(f"v{k}")[r].values, dtype=np.float64)
        if x.size != prod(box):
            raise ValueError(f"a chunk of {box} holds {x.size} cells")
        out.append(x.reshape(box))
    return out


def _reduced(np, f, x, starts: Sequence):  # noqa: ANN001, ANN202
    for axis, s in enumerate(starts):
        x = f.reduceat(x, s, axis=axis) if len(s) else x.take([], axis=axis)
    return x


def _spread_out(np, x, counts: Sequence):  # noqa: ANN001, ANN202
    for axis, c in enumerate(counts):
        x = np.repeat(x, c, axis=axis)
    return x


def _lifted(np, fields: Sequence, origin: Sequence[int], factor: Factor, extent: Factor, names: Sequence[str], skipna: bool) -> tuple[list, dict]:  # noqa: ANN001
    """(blocks along each dimension, state) of a chunk's pieces."""
    blocks, starts, counts, cut = [], [], [], []
    for o, n, f, x in zip(origin, fields[0].shape, factor, extent, strict=True):
        stop = min(o + n, x // f * f)
        at = np.arange(o, stop)
        first = np.flatnonzero(np.r_[True, at[1:] // f != at[:-1] // f][: len(at)])
        blocks.append(at[first] // f)
        starts.append(first)
        counts.append(np.diff(np.r_[first, len(at)]))
        cut.append(slice(0, max(stop - o, 0)))
    fields = [x[tuple(cut)] for x in fields]
    known = np.logical_and.reduce([~np.isnan(x) for x in fields]) if skipna else np.ones(fields[0].shape, bool)
    state = {"n": _reduced(np, np.add, known.astype(np.int64), starts)}
    x = [np.where(known, v, 0.0) for v in fields] if skipna else fields
    with np.errstate(invalid="ignore", divide="ignore"):
        means = [_reduced(np, np.add, v, starts) / state["n"] for v in x]
        off = [np.where(known, v - _spread_out(np, m, counts), 0.0) if skipna else v - _spread_out(np, m, counts) for v, m in zip(x, means, strict=True)]
    for name in names:
        if name in _MEANS:
            state[name] = means[_MEANS[name]]
        elif name in _SPREAD:
            a, b = _SPREAD[name]
            state[name] = _reduced(np, np.add, off[a] * off[b], starts)
        elif name == "s":
            state[name] = _reduced(np, np.add, x[0], starts)
        elif name in ("min", "max"):
            gone = np.inf if name == "min" else -np.inf
            state[name] = _reduced(np, np.minimum if name == "min" else np.maximum, np.where(known, fields[0], gone), starts)
        elif name == "has_nan":
            state[name] = _reduced(np, np.logical_or, np.isnan(fields[0]) & known, starts)
        elif name != "n":
            state[name] = _reduced(np, np.add, x[0] ** int(name[1:]), starts)
    return blocks, state


def _coarser(np, blocks: Sequence, state: dict, window: Factor, shape: Sequence[int]) -> tuple[list, dict]:  # noqa: ANN001
    """The pieces of coarser blocks, merged from finer ones; past the last whole block they go."""
    new, starts, counts, cut = [], [], [], []
    for b, w, n in zip(blocks, window, shape, strict=True):
        own = (b // w)[b // w < n]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
        new.append(own[first])
        starts.append(first)
        counts.append(np.diff(np.r_[first, len(own)]))
        cut.append(slice(0, len(own)))
    state = {k: v[tuple(cut)] for k, v in state.items()}
    total = _reduced(np, np.add, state["n"], starts)
    out = {"n": total}
    off = {}
    with np.errstate(invalid="ignore", divide="ignore"):
        for m in _MEANS:
            if m in state:
                known = np.where(state["n"] > 0, state[m], 0.0)
                out[m] = _reduced(np, np.add, state["n"] * known, starts) / total
                off[m] = np.where(state["n"] > 0, state[m] - _spread_out(np, out[m], counts), 0.0)
    of = list(_MEANS)
    for name, v in state.items():
        if name in _SPREAD:
            a, b = _SPREAD[name]
            out[name] = _reduced(np, np.add, v + state["n"] * off[of[a]] * off[of[b]], starts)
        elif name not in out:
            f = {"min": np.minimum, "max": np.maximum, "has_nan": np.logical_or}.get(name, np.add)
            out[name] = _reduced(np, f, v, starts)
    return new, out


def _windows(np, fields: Sequence, origin: Sequence[int], own: Factor, window: Factor, stride: Factor, first: Factor, counts: Sequence[int], names: Sequence[str]):  # noqa: ANN001, ANN202
    """(window numbers along each dimension, state) of the windows that start in a chunk."""
    at, numbers = [], []
    for o, n, w, s, f, most, size in zip(origin, own, window, stride, first, counts, fields[0].shape, strict=True):
        k = np.arange(max(0, -(-(o - f) // s)), most)
        start = k * s + f - o
        ok = (start >= 0) & (start < n) & (start + w <= size)
        numbers.append(k[ok])
        at.append(start[ok])
    if not all(len(a) for a in at):
        return None
    state = {"n": 1}
    for name in names:
        if name in _MEANS:
            state[name] = fields[_MEANS[name]]
        elif name in _SPREAD:
            state[name] = np.zeros(fields[0].shape)
        elif name in ("s", "min", "max"):
            state[name] = fields[0]
        elif name == "has_nan":
            state[name] = np.isnan(fields[0])
        elif name != "n":
            state[name] = fields[0] ** int(name[1:])
    for axis, (starts, w) in enumerate(zip(at, window, strict=True)):  # equal counts along an axis, one axis after the other
        state = _slid(np, state, axis, starts, w)
    n = state.pop("n")
    shape = tuple(len(a) for a in at)
    return numbers, {"n": np.full(shape, n, np.int64), **state}


def _slid(np, state: dict, axis: int, starts, w: int) -> dict:  # noqa: ANN001
    def over(f, x):  # noqa: ANN001, ANN202
        out = x.take(starts, axis)
        for j in range(1, w):
            out = f(out, x.take(starts + j, axis))
        return out

    new = {m: over(np.add, state[m]) / w for m in _MEANS if m in state}
    of = list(_MEANS)
    for name, x in state.items():
        if name in _SPREAD:
            (a, b), total = _SPREAD[name], over(np.add, x)
            for j in range(w):
                total = total + state["n"] * (state[of[a]].take(starts + j, axis) - new[of[a]]) * (state[of[b]].take(starts + j, axis) - new[of[b]])
            new[name] = total
        elif name == "n":
            new[name] = x * w
        elif name not in new:
            new[name] = over({"min": np.minimum, "max": np.maximum, "has_nan": np.logical_or}.get(name, np.add), x)
    return new


def _batch(np, scale: int, dims: Sequence[str], blocks: Sequence, state: dict, names: Sequence[str]) -> pa.RecordBatch:  # noqa: ANN001
    places = [g.ravel() for g in np.meshgrid(*blocks, indexing="ij")]
    columns = [pa.array(np.full(len(places[0]), scale, np.int32)), *[pa.array(p, pa.int64()) for p in places]]
    n = state["n"].ravel()
    for c in names:
        x = state[c].ravel()
        if c == "n":
            columns.append(pa.array(x, pa.int64()))
        elif c == "has_nan":
            columns.append(pa.array(x, pa.bool_()))
        else:
            columns.append(pa.array(x, pa.float64(), mask=n == 0))
    return pa.RecordBatch.from_arrays(columns, names=[SCALE, *dims, *[PREFIX + c for c in names]])
