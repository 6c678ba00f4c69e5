"""Mergeable percentiles with bounded rank error, by deterministic buffer collapsing.

A sketch is a list of sorted buffers.  A buffer of level l holds SIZE values,
each standing for FAN ** l rows; values too few for a buffer wait at weight 1.
FAN buffers of one level are merged and every FAN-th value is kept, which makes
one buffer of the next level.  Such a collapse moves any rank by at most
FAN // 2 times the weight of the level; ``err`` adds this up.  So after n
values, the error is at most n * levels / (2 * SIZE): below one per cent of
n for ten thousand million values.

Which values end up in one buffer depends on how the input is cut into
partitions; given that, everything is fixed: sketches of a key are merged in an
order of their own contents, not of their arrival.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.llm.runs import Folder
from kvartal.sources.tables import work_path

SIZE = 512
FAN = 8
FLUSH_ROWS = 500_000


class Sketch:
    """Buffers by level, values waiting, number of rows, and bound of the rank error."""

    __slots__ = ("levels", "loose", "n", "err", "waiting", "size", "fan")

    def __init__(self, size: int = SIZE, fan: int = FAN):
        self.levels: list[list[np.ndarray]] = []
        self.loose: list[np.ndarray] = []
        self.waiting = self.n = self.err = 0
        self.size, self.fan = size, fan

    def _push(self, level: int, buffer: np.ndarray) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        row = self.levels[level]
        row.append(buffer)
        if len(row) == self.fan:
            merged = np.sort(np.concatenate(row), kind="stable")
            row.clear()
            self.err += (self.fan // 2) * self.fan**level
            self._push(level + 1, merged[(self.fan - 1) // 2 :: self.fan])

    def add(self, values: np.ndarray) -> None:
        """Take values in any order."""
        self.n += len(values)
        self.loose.append(values)
        self.waiting += len(values)
        if self.waiting >= self.size:
            all_values = np.concatenate(self.loose)
            full = len(all_values) // self.size * self.size
            for i in range(0, full, self.size):
                self._push(0, np.sort(all_values[i : i + self.size]))
            self.loose, self.waiting = [all_values[full:]], len(all_values) - full

    def merge(self, levels: list[int], buffers: list[np.ndarray], n: int, err: int) -> None:
        """Take the buffers of another sketch; level -1 holds its waiting values."""
        self.err += err
        for level, values in zip(levels, buffers):
            if level < 0:
                before = self.n
                self.add(np.asarray(values))
                self.n = before
            else:
                self._push(level, np.asarray(values))
        self.n += n

    def parts(self) -> tuple[list[int], list[list[float]]]:
        levels = [i for i, row in enumerate(self.levels) for _ in row]
        buffers = [b for row in self.levels for b in row]
        if self.waiting:
            levels.append(-1)
            buffers.append(np.sort(np.concatenate(self.loose)))
        return levels, buffers

    def quantiles(self, shares: list[float]) -> list[float]:
        """Values at rank ceil(share * n) of the weighted rows, at least the first."""
        levels, buffers = self.parts()
        values = np.concatenate(buffers)
        weights = np.concatenate([np.full(len(b), self.fan ** max(0, level)) for level, b in zip(levels, buffers)])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        ranks = [max(1, math.ceil(round(s * self.n, 9))) for s in shares]
        return [float(values[order[min(len(order) - 1, np.searchsorted(upto, r))]]) for r in ranks]


def _schemas(df: DataFrame, keys: list[str]) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_type

    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    fields = [pa.field(k, to_arrow_type(df.schema[k].dataType)) for k in keys]
    fields += [pa.field("levels", pa.list_(pa.int32())), pa.field("buffers", pa.list_(pa.list_(pa.float64()))), pa.field("n", pa.int64()), pa.field("err", pa.int64())]
    return head + ", levels array<int>, buffers array<array<double>>, n long, err long", pa.schema(fields)


def _batch(keys: list[pa.Array], out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    rest = list(schema)[len(keys) :]
    values = zip(*out) if out else [[]] * len(rest)
    return pa.RecordBatch.from_arrays([*[k.cast(f.type) for k, f in zip(keys, schema)], *[pa.array(list(v), type=f.type) for v, f in zip(values, rest)]], schema=schema)


def _one_zero(df: DataFrame, keys: list[str]) -> list:
    """Key columns in which zero has one sign."""
    return [(F.col(k) + F.lit(0.0).cast(t)).alias(k) if (t := df.schema[k].dataType.simpleString()) in ("float", "double") else F.col(k) for k in keys]


def partial_sketches(df: DataFrame, keys: list[str], value: str, size: int = SIZE, fan: int = FAN) -> DataFrame:
    """Sketches of ``value`` per combination of ``keys``: columns keys, levels, buffers, n, err.

    Input partitions are condensed in place, ``FLUSH_ROWS`` rows at a time,
    so only sketches are shuffled; then those of a key are merged as they
    stream by in key order.  Keys keep their type: they stay in Arrow, and any
    that Spark can sort will do.  NULL and NaN values are passed over; a key of
    nothing else has no row; NULL keys are keys, as is NaN.
    """
    head, schema = _schemas(df, keys)
    names = [f"k{i}" for i in range(len(keys))]

    def condense(batches):
        waiting, count = [], 0

        def flush():
            rows = pa.Table.from_batches(waiting).rename_columns([*names, "_v"])
            # NaN isn't equal to itself: it is told from NULL by a flag and put back.
            flags = {k: pa.compute.is_nan(rows.column(k)) for k in names if pa.types.is_floating(rows.schema.field(k).type)}
            for k, flag in flags.items():
                rows = rows.append_column("nan" + k, flag).set_column(rows.schema.get_field_index(k), k, pa.compute.if_else(flag, pa.scalar(0.0, rows.schema.field(k).type), rows.column(k)))
            groups = rows.group_by([*names, *["nan" + k for k in flags]], use_threads=False).aggregate([("_v", "list")])
            lists, out = groups.column("_v_list").combine_chunks(), []
            for values in lists:
                s = Sketch(size, fan)
                s.add(values.values.to_numpy())
                out.append((*s.parts(), s.n, s.err))
            columns = [pa.compute.if_else(groups.column("nan" + k), pa.scalar(math.nan, groups.schema.field(k).type), groups.column(k)) if k in flags else groups.column(k) for k in names]
            return _batch([c.combine_chunks() for c in columns], out, schema)

        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count >= FLUSH_ROWS:
                yield flush()
                waiting, count = [], 0
        if count:
            yield flush()

    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*_one_zero(df, keys), F.col(value).cast("double").alias("_v"))
    return merge_sketches(rows.mapInArrow(condense, head), keys, size, fan)


def _streamed(keys: list[str], schema: pa.Schema, finish, size: int, fan: int):
    """Merge rows of equal keys that come one after another."""

    def merge(batches):
        now, sketch, last = None, None, None
        for batch in batches:
            out, rows = [], []
            names = [[("nan",) if v != v else v for v in batch.column(k).to_pylist()] for k in keys]
            levels, n, err = batch.column("levels").to_pylist(), batch.column("n").to_pylist(), batch.column("err").to_pylist()
            buffers = batch.column("buffers")
            own = [batch.column(k) for k in keys]
            for i, key in enumerate(zip(*names)):
                if key != now or sketch is None:
                    if sketch is not None:
                        out.append(finish(sketch))
                        rows.append(i - 1)
                    now, sketch = key, Sketch(size, fan)
                sketch.merge(levels[i], [b.values.to_numpy() for b in buffers[i]], n[i], err[i])
            if out:
                # The first may have ended with the last batch.
                ended = [pa.concat_arrays([last[j], c]).take(pa.array([r + 1 for r in rows])) if last else c.take(pa.array(rows)) for j, c in enumerate(own)]
                yield _batch(ended, out, schema)
            if batch.num_rows:
                last = [c.slice(batch.num_rows - 1, 1) for c in own]
        if sketch is not None:
            yield _batch(last, [finish(sketch)], schema)

    return merge


def _in_order(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of a key together and in an order that their contents fix."""
    return sketches.select(*_one_zero(sketches, keys), "levels", "buffers", "n", "err").repartition(*keys).sortWithinPartitions(*keys, F.desc("n"), "err", "levels", "buffers")


def merge_sketches(sketches: DataFrame, keys: list[str], size: int = SIZE, fan: int = FAN) -> DataFrame:
    """Sketches over ``keys``, a subset of those the rows of ``sketches`` have."""
    head, schema = _schemas(sketches, keys)
    return _in_order(sketches, keys).mapInArrow(_streamed(keys, schema, lambda s: (*s.parts(), s.n, s.err), size, fan), head)


def sketch_percentiles(sketches: DataFrame, keys: list[str], shares: dict[str, float], size: int = SIZE, fan: int = FAN) -> DataFrame:
    """Percentiles of merged sketches: keys, one column for each of ``shares``, ``n_values`` and ``rank_error``, the bound in rows."""
    head, schema = _schemas(sketches, keys)
    schema = pa.schema([*list(schema)[: len(keys)], *[pa.field(c, pa.float64()) for c in shares], pa.field("n_values", pa.int64()), pa.field("rank_error", pa.int64())])
    head = head[: head.index(", levels")] + "".join(f", `{c}` double" for c in shares) + ", n_values long, rank_error long"
    return _in_order(sketches, keys).mapInArrow(_streamed(keys, schema, lambda s: (*s.quantiles(list(shares.values())), s.n, s.err), size, fan), head)


def percentiles_by_batch(df: DataFrame, groups: list[str], batch: str, value: str, shares: dict[str, float], root: str | None = None, size: int = SIZE, fan: int = FAN) -> DataFrame:
    """Percentiles per group from partial results that are kept per batch in a shared folder and combined.

    Batches that the folder ``root`` already keeps are not read again; those
    that are new in ``df`` are sketched, added, and named in a manifest that is
    written last.  The result covers all that is kept.  A batch is one unit:
    rows that come for it later are not added.
    """
    spark = df.sparkSession
    root = root or work_path(spark, "sketches")
    folder = Folder(root)
    names = folder.names("manifest")
    kept = json.loads(folder.get(names[-1])) if names else {"batches": [], "paths": []}
    there = [r[0] for r in df.select(batch).distinct().collect()]  # one row a batch
    new = [b for b in there if b not in kept["batches"]]
    fresh = df
    if len(new) < len(there):
        known = [b for b in new if b is not None]
        fresh = df.where(F.col(batch).isin(known) | (F.col(batch).isNull() if None in new else F.lit(False))) if new else df.limit(0)
    sketches = partial_sketches(fresh, [batch, *groups], value, size, fan)
    if new or not names:
        path = folder.new_name("parts", f"{len(names):08d}", "parquet")
        sketches.write.parquet(f"{root}/{path}")
        kept = {"batches": kept["batches"] + new, "paths": kept["paths"] + [path]}
        folder.commit(f"manifest/{len(names):08d}.json", json.dumps(kept).encode())
    return sketch_percentiles(spark.read.schema(sketches.schema).parquet(*[f"{root}/{p}" for p in kept["paths"]]), groups, shares, size, fan)
