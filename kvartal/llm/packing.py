"""Best-fit packing of items into containers of fixed capacity, in bulk-synchronous rounds.

A round sorts the items left and the gaps of open containers together, by range
partitions from the largest down, a gap before an item of its size.  In each
partition a sweep gives every item the smallest gap there that takes it (its
successor), and gaps that stay in the partition's range can be taken again.
Items for which the partition has no gap go to gaps left over in partitions
above: from the counts of both in each partition, and nothing else, it follows
which rank of items meets which rank of gaps, the nearest ones first, so no two
items ask for one gap.  Gaps are updated and the next round sorts what is left.

When no item fits any gap, containers are opened: one for each item of more
than half the capacity, and at least as many as the items left would fill, for
the largest.  What few items and gaps are left at last, one task packs by plain
best fit in descending order.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.sources.tables import stored

#: Items and gaps that one sweep takes.
SWEEP_ROWS = 50_000
#: Share of the containers that the items would fill which is opened at first; later items open the rest where they need them.
FIRST_SHARE = 0.98
MOST_ROUNDS = 10_000


def best_fit(sizes, gaps: list[tuple[int, int]], least: int, opens: int | None = None, capacity: int = 0):
    """Give items, in descending order, the smallest gaps that take them.

    ``gaps`` are sorted (gap, container).  A gap that becomes less than
    ``least`` is set aside.  With ``opens``, the number of the next container,
    items that fit nowhere open one; else they get -1.  Returns the containers
    of the items, the gaps left, sorted, those set aside, and the next number.
    """
    out, aside = np.full(len(sizes), -1, dtype=np.int64), []
    for i, s in enumerate(sizes):
        at = bisect.bisect_left(gaps, (s, -1))
        if at < len(gaps):
            gap, container = gaps.pop(at)
        elif opens is not None:
            gap, container = capacity, opens
            opens += 1
        else:
            continue
        out[i] = container
        rest = (gap - s, container)
        if rest[0] >= least:
            bisect.insort(gaps, rest)
        elif rest[0] > 0:
            aside.append(rest)
    return out, gaps, aside, opens


def meetings(items: list[int], gaps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(partition, rank of its first item, number, partition of the gaps, rank of the first gap): who of those left over meets.

    ``items`` and ``gaps`` count them by partition, from the largest values
    down.  Items take gaps of the partitions above, the nearest first.
    """
    stack, out = [], []
    for p, (wanting, offered) in enumerate(zip(items, gaps)):
        rank = 0
        while rank < wanting and stack:
            q, first, n = stack.pop()
            take = min(n, wanting - rank)
            out.append((p, rank, take, q, first))
            rank += take
            if take < n:
                stack.append((q, first + take, n - take))
        if offered:
            stack.append((p, 0, offered))
    return out


def _row_schema(id_type: str) -> str:
    # kind 0: gap, 1: item; p and k: partition and rank of those left over.
    return f"kind int, id {id_type}, piece_no int, n_size long, container_id long, value long, p int, k long"


def _sorted_range(events: DataFrame, parts: int) -> DataFrame:
    """From the largest value down, gaps before items; equals are spread by a hash, so that no size makes a partition of its own."""
    return events.repartitionByRange(parts, F.desc("value"), "kind", F.xxhash64("id", "piece_no", "container_id"))


def _table(batches: list[pa.RecordBatch]) -> pa.Table:
    t = pa.Table.from_batches(batches)
    return t.cast(pa.schema([pa.field(f.name, f.type) for f in t.schema]))


def _sweep(batches):
    got = list(batches)
    if not got:
        return
    t = _table(got)
    kind, value = t.column("kind").to_numpy(), t.column("value").to_numpy()
    items = np.flatnonzero(kind == 1)
    items = items[np.argsort(-value[items], kind="stable")]
    rows = np.flatnonzero(kind == 0)
    containers = t.column("container_id").to_numpy()[rows] if len(rows) else np.empty(0, dtype=np.int64)
    gaps = sorted(zip(value[rows].tolist(), containers.tolist()))
    got_container, left, aside, _ = best_fit(value[items].tolist(), gaps, int(value.min()))
    p = TaskContext.get().partitionId()
    placed = got_container >= 0
    wanting = items[~placed]
    yield from _rows(t, items[placed], got_container[placed], value[items[placed]], -1, None)
    yield from _rows(t, wanting, np.full(len(wanting), -1), value[wanting], p, np.arange(len(wanting)))
    yield from _gap_rows(t.schema, left, p, np.arange(len(left)))
    yield from _gap_rows(t.schema, aside, -1, None)


def _rows(t: pa.Table, at: np.ndarray, containers: np.ndarray, value: np.ndarray, p: int, k) -> list[pa.RecordBatch]:
    out = t.take(pa.array(at))
    for name, column in (("container_id", containers), ("value", value), ("p", np.full(len(at), p)), ("k", np.full(len(at), -1) if k is None else k)):
        i = t.schema.get_field_index(name)
        out = out.set_column(i, t.schema.field(i), pa.array(column).cast(t.schema.field(i).type))
    return out.to_batches()


def _gap_rows(schema: pa.Schema, gaps: list[tuple[int, int]], p: int, k) -> list[pa.RecordBatch]:
    n = len(gaps)
    if not n:
        return []
    value, containers = (list(x) for x in zip(*gaps))
    has = {"kind": [0] * n, "container_id": containers, "value": value, "p": [p] * n, "k": [-1] * n if k is None else k.tolist()}
    return [pa.RecordBatch.from_arrays([pa.array(has[f.name], f.type) if f.name in has else pa.nulls(n, f.type) for f in schema], schema=schema)]


def _ranked(batches):
    """Rows of a range partition with their rank in it."""
    got = list(batches)
    if got:
        t = _table(got)
        order = np.argsort(-t.column("value").to_numpy(), kind="stable")
        yield from _rows(t, order, np.full(len(order), -1), t.column("value").to_numpy()[order], TaskContext.get().partitionId(), np.arange(len(order)))


def _finish(capacity: int, opens: int):
    def run(batches):
        got = list(batches)
        if not got:
            return
        t = _table(got)
        kind, value = t.column("kind").to_numpy(), t.column("value").to_numpy()
        items, rows = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
        items = items[np.argsort(-value[items], kind="stable")]
        gaps = sorted(zip(value[rows].tolist(), t.column("container_id").take(pa.array(rows)).to_pylist()))
        containers, *_ = best_fit(value[items].tolist(), gaps, 1, opens, capacity)
        yield from _rows(t, items, containers, value[items], -1, None)

    return run


def _counts(ranked: DataFrame, kind: int, parts: int) -> list[int]:
    """Rows left over by partition; one row a partition comes to the driver."""
    out = [0] * parts
    for r in ranked.where(f"p >= 0 and kind = {kind}").groupBy("p").count().collect():
        out[r["p"]] = r["count"]
    return out


def pack(items: DataFrame, item_id: str, size: str, capacity: int, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """(``item_id``, piece_no, n_size, container_id): every item in containers of ``capacity``.

    An item above the capacity, and only such, is cut into full pieces and a
    rest.  Items of size zero, negative or NULL take no room: one piece of size
    0 with NULL container.  Repeated ids are packed as items of their own.
    Containers are numbered from 0.  Items and gaps up to ``sweep_rows`` are
    packed by one task; with more, rounds go on until so few are left.
    """
    id_type = items.schema[item_id].dataType.simpleString()
    d = items.select(F.col(item_id).alias("id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("all"))
    last = F.floor(F.greatest(F.col("all") - 1, F.lit(0)) / capacity)
    pieces = d.select("id", "all", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece_no"))
    pieces = stored(pieces.select("id", F.col("piece_no").cast("int").alias("piece_no"), F.least(F.lit(capacity), F.col("all") - F.col("piece_no") * capacity).cast("long").alias("n_size")), "pieces")
    schema = _row_schema(id_type)
    none = F.lit(None)
    left = pieces.where("n_size > 0").select(
        F.lit(1).alias("kind"), "id", "piece_no", "n_size", none.cast("long").alias("container_id"), F.col("n_size").alias("value"), F.lit(-1).alias("p"), F.lit(-1).cast("long").alias("k")
    )
    gaps = None
    opened, first, placed = 0, True, []
    for _ in range(MOST_ROUNDS):
        wants = left.agg(F.count("*").alias("n"), F.sum("value").alias("all"), F.min("value").alias("least"), F.count_if(2 * F.col("value") > capacity).alias("big")).first()
        if not wants["n"]:
            break
        if gaps is not None:
            gaps = gaps.where(F.col("value") >= wants["least"])
        offers = gaps.agg(F.count("*").alias("n"), F.max("value").alias("most")).first() if gaps is not None else {"n": 0, "most": None}
        events = left if gaps is None else left.unionByName(gaps)
        if wants["n"] + offers["n"] <= sweep_rows:
            placed.append(stored(events.repartition(1).mapInArrow(_finish(capacity, opened), schema), "packed"))
            break
        parts = max(2, -(-(wants["n"] + offers["n"]) // sweep_rows))
        if not offers["n"]:
            # No item fits any gap: open containers for the largest.
            number = min(wants["n"], max(1, wants["big"], int(np.ceil(-(-wants["all"] // capacity) * (FIRST_SHARE if first else 1)))))
            first = False
            ranked = stored(_sorted_range(left, parts).mapInArrow(_ranked, schema), "ranked")
            before = np.concatenate([[0], np.cumsum(_counts(ranked, 1, parts))])
            rank = F.col("k") + F.element_at(F.lit(before.tolist()), F.col("p") + 1)
            ranked = ranked.withColumn("_rank", rank)
            taken = ranked.where(F.col("_rank") < number).withColumn("container_id", F.col("_rank") + opened).drop("_rank")
            placed.append(taken)
            fresh = taken.where(F.col("value") < capacity).select(
                F.lit(0).alias("kind"), none.cast(id_type).alias("id"), none.cast("int").alias("piece_no"), none.cast("long").alias("n_size"), "container_id", (capacity - F.col("value")).alias("value"), F.lit(-1).alias("p"), F.lit(-1).cast("long").alias("k")
            )
            left = ranked.where(F.col("_rank") >= number).drop("_rank")
            gaps, opened = fresh, opened + number
            continue
        swept = stored(_sorted_range(events, parts).mapInArrow(_sweep, schema), "swept")
        pairs = meetings(_counts(swept, 1, parts), _counts(swept, 0, parts))
        met = stored(_meet(swept, pairs, schema), "met")
        placed += [swept.where("kind = 1 and container_id >= 0"), met.where("kind = 1 and container_id >= 0")]
        left, gaps = met.where("kind = 1 and container_id < 0"), met.where("kind = 0")
    else:
        raise RuntimeError("items did not settle")
    out = pieces.where("n_size <= 0").select("id", "piece_no", "n_size", none.cast("long").alias("container_id"))
    for table in placed:
        out = out.unionByName(table.select("id", "piece_no", "n_size", "container_id"))
    return out.select(F.col("id").alias(item_id), "piece_no", F.col("n_size").cast("int").alias("n_size") if capacity < 2**31 else "n_size", "container_id")


def _meet(swept: DataFrame, pairs: list[tuple[int, int, int, int, int]], schema: str) -> DataFrame:
    """Items and gaps after those left over have met; ``pairs`` has at most two rows for each partition."""
    table = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 5)

    def slots(batches):
        for batch in batches:
            t = _table([batch])
            p, k = t.column("p").to_numpy().astype(np.int64), t.column("k").to_numpy()
            q, g = np.full(len(p), -1), np.full(len(p), -1)
            if len(table):
                at = np.searchsorted(table[:, 0] * (1 << 40) + table[:, 1], p * (1 << 40) + k, side="right") - 1
                row = table[np.maximum(at, 0)]
                good = (at >= 0) & (row[:, 0] == p) & (k < row[:, 1] + row[:, 2])
                q, g = np.where(good, row[:, 3], -1), np.where(good, row[:, 4] + k - row[:, 1], -1)
            for name, column in (("p", q), ("k", g)):
                i = t.schema.get_field_index(name)
                t = t.set_column(i, t.schema.field(i), pa.array(column).cast(t.schema.field(i).type))
            yield from t.to_batches()

    wanting = swept.where("kind = 1 and container_id < 0").mapInArrow(slots, schema)
    offered = swept.where("kind = 0")
    taker = wanting.where("p >= 0").select(F.col("p").alias("_p"), F.col("k").alias("_k"), F.col("value").alias("_s"))
    giver = offered.where("p >= 0").select(F.col("p").alias("_p"), F.col("k").alias("_k"), F.col("container_id").alias("_c"))
    given = wanting.join(giver.hint("merge"), (F.col("p") == F.col("_p")) & (F.col("k") == F.col("_k")), "left").withColumn("container_id", F.coalesce("_c", F.lit(-1).cast("long"))).drop("_p", "_k", "_c")
    rest = offered.join(taker.hint("merge"), (F.col("p") == F.col("_p")) & (F.col("k") == F.col("_k")), "left").withColumn("value", F.col("value") - F.coalesce("_s", F.lit(0).cast("long"))).drop("_p", "_k", "_s")
    return given.unionByName(rest.where("value > 0"))
