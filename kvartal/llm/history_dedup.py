"""Deduplication of new batches against everything accepted before.

The store is a folder that any process can open.  Its key space is cut into
buckets.  A bucket holds, of accepted rows only, its part of three tables, each
in runs sorted by key (:mod:`kvartal.llm.runs`): fingerprints of photo sets, the
sets with their listing, and the listings with their latest moment; and one
Bloom filter of all its keys, rebuilt at twice the size when it is full.  What a
batch wrote counts from the moment its manifest appears, which is written last.

A batch makes winnowed fingerprints: of a set's photos as many of the rarest as
must include a common one with any set that shares half of all.  The filters
screen them; positives are looked up in the runs of their bucket, of which only
the row groups around them are read; sets found are verified by their shared
coverage.  So a batch shuffles its own keys and what it finds, and not history.

A photo in very many sets is hot from then on.  Sets that have only hot photos
in common are found by pairs of them (or, as there one is enough, by size if
they have one or two photos); in the order that winnowing goes by, hot photos
come last, the latest to become hot first.  Thus a posting made before its photo
was hot is still found, and no list of a photo grows on after that.

What history leaves of a batch is settled within itself in the order of rows.
Which rows are accepted is fixed by the rule (a row is refused on account of
accepted earlier rows only).  A batch of up to ``settle_rows`` is settled by one
task in one pass.  Larger ones are taken in waves that double, so that history
refuses most repeats of a hot group before pairs are made, and each wave is
settled in distributed rounds: a row is refused as soon as an accepted row
speaks against it, and accepted as soon as no accepted or open earlier one does.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as w

from kvartal.functions.moments import moment_us
from kvartal.llm import bloom
from kvartal.llm.near_duplicates import prefix_length
from kvartal.llm.runs import Bucket, Folder, among
from kvartal.llm.tokensets import HOT_BOUND, flat_lists, mix, photo_keys, positions
from kvartal.sources.tables import stored, work_path

ORDER_STEP = 1 << 40
SHARE = 0.5
#: Sets from which a photo is hot; more where there are so many that their number would exceed HOT_BOUND.
HOT_SETS = 64
#: Rows of a batch that one task settles.
SETTLE_ROWS = 200_000
#: Keys of a bucket; their number doubles when the store outgrows it.
BUCKET_KEYS = 1_000_000
LEAST_BUCKETS = 4
PAIRS_AT_ONCE = 200_000

# Kinds of rows that flow through an ingest, all of one schema.
PROBE, OLD_PROBE, LISTING, CANDIDATE, LATEST, OWNER, COUNTS, ROW, HOT, NEW_ROW, NEW_LISTING, NEW_SET, NEW_FINGERPRINT, TOUCH = range(14)
FLOW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("m", pa.int64()), ("tokens", pa.list_(pa.int64()))])
FLOW_SCHEMA = "bucket int, kind int, a long, b long, c long, m long, tokens array<long>"
DONE_SCHEMA = "bucket int, state string, keys long, hot array<long>, grown array<long>, counts array<long>"
#: Uses of a key: to look with, to be found by within the batch, to be found by in the store.
LOOK, HERE, LATER = 1, 2, 4


def prepared(rows: DataFrame) -> DataFrame:
    """Rows as the store takes them: row_no, batch, seq, lid, moment, setid, tokens.

    A row without a listing is a listing of its own; a row without photos has
    NULL ``setid``; NULL ``batch_no`` is a batch before all others.
    """
    batch = F.coalesce(F.col("batch_no").cast("long") + 1, F.lit(0).cast("long"))
    return (
        rows.select(
            "row_no", batch.alias("batch"), (batch * ORDER_STEP + F.col("row_no")).alias("seq"),
            F.when(F.col("listing_id").isNull(), F.xxhash64(F.lit("no listing"), "row_no")).otherwise(F.xxhash64("listing_id")).alias("lid"),
            moment_us(F.col("updated_at")).alias("moment"), photo_keys(F.col("photos")).alias("tokens"),
        )
        .withColumn("setid", F.when(F.size("tokens") > 0, F.xxhash64("tokens")))
    )


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def _photo_key(tokens: np.ndarray) -> np.ndarray:
    return _signed(mix(tokens, 3))


def _listing_key(lids: np.ndarray) -> np.ndarray:
    return _signed(mix(lids, 7))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys, 77) % np.uint64(buckets)).astype(np.int32)


def _epochs(tokens: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Epoch at which a token became hot, -1 for cold ones; ``hot`` has sorted photo keys and their epochs."""
    keys, epochs = hot
    out = np.full(len(tokens), -1, dtype=np.int64)
    if len(keys):
        k = _photo_key(tokens)
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        out = np.where(keys[at] == k, epochs[at], out)
    return out


def _with_hot(hot: tuple[np.ndarray, np.ndarray], keys: np.ndarray, epoch: int) -> tuple[np.ndarray, np.ndarray]:
    """``hot`` with further photo keys that became so at ``epoch``."""
    keys = np.setdiff1d(keys, hot[0])
    every = np.concatenate([hot[0], keys])
    order = np.argsort(every, kind="stable")
    return every[order], np.concatenate([hot[1], np.full(len(keys), epoch)])[order]


def set_keys(values: np.ndarray, owner: np.ndarray, sizes: np.ndarray, hot: tuple[np.ndarray, np.ndarray]):
    """Keys of token sets: (owner, key, use, whether it is a photo's own key)."""
    epoch = _epochs(values, hot)
    heat = epoch >= 0
    rank = positions(owner, heat, -epoch, mix(values, 1))
    near = rank < prefix_length(sizes)[owner]
    use = np.where(heat, LOOK * near, LATER + (LOOK + HERE) * near)
    keep = use > 0
    at, key, uses, own = [owner[keep]], [_photo_key(values[keep])], [use[keep]], [np.ones(keep.sum(), dtype=bool)]
    if heat.any():
        hots = np.bincount(owner, heat, minlength=len(sizes)).astype(np.int64)
        for n, kind, other in ((1, 0, 0), (1, 1, 1), (2, 1, 0)):
            # One photo alone finds one alone (key 0), and those of two with it (key 1); two find one.
            pick = np.flatnonzero(heat & (sizes[owner] == n))
            ways = [(kind, LOOK + HERE + LATER)] if (n, kind) == (1, 0) else [(kind, LOOK)] if n == 1 else [(kind, HERE + LATER), (other, LOOK)]
            for which, way in ways:
                at.append(owner[pick])
                key.append(_signed(mix(mix(values[pick], 4).view(np.int64) ^ which, 3)))
                uses.append(np.full(len(pick), way))
        shared = np.maximum(2, -(-sizes // 2))
        for i in np.flatnonzero(hots >= shared):
            mine = np.arange(*np.searchsorted(owner, [i, i + 1]))
            few = mine[heat[mine]]
            few = few[np.argsort(rank[few])][: hots[i] - shared[i] + 2]
            x, y = np.triu_indices(len(few), 1)
            at.append(np.full(len(x), i))
            one, two = mix(values[few[x]], 5), mix(values[few[y]], 5)
            key.append(_signed(mix((one + two).view(np.int64), 6)))
            uses.append(np.full(len(x), LOOK + HERE + LATER))
        own += [np.zeros(len(u), dtype=bool) for u in uses[1:]]
    return np.concatenate(at), np.concatenate(key), np.concatenate(uses), np.concatenate(own)


def _flow(kind, bucket, a, b=None, c=None, m=None, tokens=None) -> pa.Table:
    n = len(a)
    whole = lambda v: pa.nulls(n, pa.int64()) if v is None else v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(np.asarray(v, dtype=np.int64))
    bucket = np.full(n, bucket, dtype=np.int32) if np.isscalar(bucket) else np.asarray(bucket, dtype=np.int32)
    tokens = pa.nulls(n, pa.list_(pa.int64())) if tokens is None else tokens
    return pa.table([pa.array(bucket), pa.array(np.full(n, kind, dtype=np.int32)), whole(a), whole(b), whole(c), whole(m), tokens], schema=FLOW)


def _sent(tables: list[pa.Table]):
    for t in tables:
        yield from t.to_batches(max_chunksize=50_000)


def _gathered(batches) -> pa.Table:
    got = list(batches)
    return pa.Table.from_batches(got).cast(FLOW) if got else FLOW.empty_table()


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _probes(hot, buckets: int):
    """What a batch looks for: keys of its sets with their tokens, and its listings."""

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            sets = t.filter(t.column("setid").is_valid())
            if sets.num_rows:
                setid, first = np.unique(_column(sets, "setid"), return_index=True)
                tokens = sets.column("tokens").combine_chunks().take(pa.array(first))
                values, owner, sizes = flat_lists(tokens)
                at, key, use, own = set_keys(values, owner, sizes, hot)
                look = (use & LOOK) > 0
                at, key = at[look], key[look]
                kind = np.where((use[look] & HERE) > 0, PROBE, OLD_PROBE)
                yield from _sent([_flow(PROBE, bucket_of(key, buckets), key, setid[at], sizes[at], kind, tokens.take(pa.array(at)))])
            lids = np.unique(_column(t, "lid"))
            yield from _sent([_flow(LISTING, bucket_of(lids, buckets), lids)])

    return run


def shared_counts(left, right, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common tokens of pairs of sets; ``left`` and ``right`` are list arrays of distinct tokens."""
    out = np.zeros(len(i), dtype=np.int64)
    for start in range(0, len(i), PAIRS_AT_ONCE):
        part = []
        for lists, at in ((left, i), (right, j)):
            values, owner, _ = flat_lists(lists.take(pa.array(at[start : start + PAIRS_AT_ONCE])))
            part.append((owner, values))
        owner, values = (np.concatenate(x) for x in zip(*part))
        order = np.lexsort((values, owner))
        owner, values = owner[order], values[order]
        same = (owner[1:] == owner[:-1]) & (values[1:] == values[:-1])
        count = np.bincount(owner[1:][same])
        out[start : start + len(count)] = count
    return out


def _spread(first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges (first, number): the range of each member, and the members one after another."""
    at = np.repeat(np.arange(len(first)), number)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number) + first[at]


def _fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (2 * n >= m) & (2 * m >= n)


def _find(root: str, states: list[str | None]):
    """In the task of a bucket: screen keys by its filter and look positives up; candidates and latest moments come out."""

    def run(batches):
        t = _gathered(batches)
        folder, buckets = Folder(root), len(states)
        for b in np.unique(_column(t, "bucket")):
            mine = t.filter(pa.array(_column(t, "bucket") == b))
            bucket = Bucket(folder, states[b])
            if bucket.state["filter"] is None:
                continue
            bits = np.frombuffer(folder.get(bucket.state["filter"]), dtype=np.uint8)
            kind = _column(mine, "kind")
            lids = np.unique(_column(mine.filter(pa.array(kind == LISTING)), "a"))
            probes = mine.filter(pa.array(kind == PROBE))
            keys = np.unique(_column(probes, "a"))
            some = keys[bloom.may_hold(bits, keys)]
            known = lids[bloom.may_hold(bits, _listing_key(lids))]
            found, read = bucket.lookup("fingerprints", some)
            hits = 0
            if found:
                f = pa.concat_tables(found)
                p = probes.filter(pa.array(among(_column(probes, "a"), some)))
                order = np.argsort(_column(f, "k"), kind="stable")
                k, owner, n = (_column(f, c)[order] for c in ("k", "setid", "n"))  # n is negative where k is no photo's own key
                hits = len(np.unique(k))
                low, high = np.searchsorted(k, _column(p, "a"), "left"), np.searchsorted(k, _column(p, "a"), "right")
                at, which = _spread(low, high - low)
                fit = _fits(_column(p, "c")[at], np.abs(n[which]))
                at, which = at[fit], which[fit]
                pair, first = np.unique(np.stack([_column(p, "b")[at], owner[which]], axis=1), axis=0, return_index=True)
                tokens = p.column("tokens").combine_chunks().take(pa.array(at[first]))
                yield from _sent([_flow(CANDIDATE, bucket_of(pair[:, 1], buckets), pair[:, 0], pair[:, 1], tokens=tokens)])
            found, more = bucket.lookup("listings", known)
            if found:
                latest = _newest(pa.concat_tables(found))
                hits += latest.num_rows
                yield from _sent([_flow(LATEST, b, latest.column("lid"), m=latest.column("moment"))])
            yield from _sent([_flow(COUNTS, b, [len(keys) + len(lids)], [len(some) + len(known)], [hits], [read + more])])

    return run


def _verify(root: str, states: list[str | None]):
    """In the task of a bucket: which candidates share half; each set comes out with at most two of its owners, and whether it is known itself."""

    def run(batches):
        t = _gathered(batches)
        folder, kind = Folder(root), _column(t, "kind")
        yield from _sent([t.filter(pa.array(kind != CANDIDATE))])
        for b in np.unique(_column(t, "bucket")[kind == CANDIDATE]):
            mine = t.filter(pa.array((kind == CANDIDATE) & (_column(t, "bucket") == b)))
            pair, first = np.unique(np.stack([_column(mine, "a"), _column(mine, "b")], axis=1), axis=0, return_index=True)
            tokens = mine.column("tokens").combine_chunks().take(pa.array(first))
            found, read = Bucket(folder, states[b]).lookup("sets", np.unique(pair[:, 1]))
            if found:
                sets = pa.concat_tables(found)
                order = np.argsort(_column(sets, "setid"), kind="stable")
                setid, lid, lists = _column(sets, "setid")[order], _column(sets, "lid")[order], sets.column("tokens").combine_chunks().take(pa.array(order))
                low, high = np.searchsorted(setid, pair[:, 1], "left"), np.searchsorted(setid, pair[:, 1], "right")
                i, j = _spread(low, high - low)
                n, m = (np.diff(x.offsets.to_numpy()) for x in (tokens, lists))
                common = shared_counts(tokens, lists, i, j)
                good = common >= SHARE * (n[i] + m[j] - common)
                a, same = pair[i[good], 0], pair[i[good], 0] == pair[i[good], 1]
                own = lid[j[good]]
                order = np.lexsort((own, a))
                a, own, same = a[order], own[order], same[order]
                start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, dtype=np.int64)
                if len(start):
                    end = np.r_[start[1:], len(a)] - 1
                    yield from _sent([_flow(OWNER, b, a[start], own[start], own[end], np.logical_or.reduceat(same, start).astype(np.int64))])
            yield from _sent([_flow(COUNTS, b, [0], [0], [0], [read])])

    return run


def _newest(listings: pa.Table) -> pa.Table:
    """Rows (lid, moment) folded to the latest moment of each, NULL where none has one."""
    g = listings.group_by("lid").aggregate([("moment", "max")]).rename_columns(["lid", "moment"]).select(["lid", "moment"])
    return g.take(pa.array(np.argsort(_column(g, "lid"), kind="stable")))


def _nullable(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    c = t.column(name)
    return c.fill_null(0).to_numpy(), c.is_valid().to_numpy()


def _settle(hot, now: int, limit: int, buckets: int):
    """One pass over the rows of a small batch, in their order; accepted rows come out as rows to be stored."""

    def run(batches):
        t = _gathered(batches)
        kind = _column(t, "kind")
        part = lambda k: t.filter(pa.array(kind == k))
        yield from _sent([part(COUNTS)])
        rows = part(ROW)
        rows = rows.take(pa.array(np.argsort(_column(rows, "a"), kind="stable")))
        seq, lid = _column(rows, "a"), _column(rows, "b")
        (setid, has_set), (moment, has_moment) = _nullable(rows, "c"), _nullable(rows, "m")
        latest: dict[int, int | None] = dict(zip(*(part(LATEST).column(c).to_pylist() for c in ("a", "m"))))
        owners: dict[int, set[int]] = {}
        known = set()
        for a, b, c, same in zip(*(part(OWNER).column(c).to_pylist() for c in "abcm")):
            owners.setdefault(a, set()).update((b, c))
            if same:
                known.add(a)
        sets, first, inverse = np.unique(setid[has_set], return_index=True, return_inverse=True)
        tokens = rows.column("tokens").combine_chunks().take(pa.array(np.flatnonzero(has_set)[first])) if len(sets) else pa.array([], pa.list_(pa.int64()))
        values, owner, sizes = flat_lists(tokens)
        # Photos that became hot within this batch, counted over its sets.
        keys, count = np.unique(_photo_key(values), return_counts=True)
        fresh = keys[(count > limit) & ~among(keys, hot[0])]
        if len(fresh):
            yield from _sent([_flow(HOT, 0, fresh)])
        heat = _with_hot(hot, fresh, 2 * now)
        at, key, use, own = set_keys(values, owner, sizes, heat)
        # Only keys that two sets of the batch have can settle anything here.
        here = (use & (LOOK + HERE)) > 0
        unique, times = np.unique(key[here], return_counts=True)
        busy = np.flatnonzero(here & among(key, unique[times > 1]))
        busy = busy[np.argsort(at[busy], kind="stable")]
        of_set = np.full(len(rows), -1, dtype=np.int64)
        of_set[has_set] = inverse
        begin, end = np.searchsorted(at[busy], np.arange(len(sets)), "left"), np.searchsorted(at[busy], np.arange(len(sets)), "right")
        _, which, times = np.unique(lid, return_inverse=True, return_counts=True)
        again = times[which] > 1
        copies = np.bincount(of_set[of_set >= 0], minlength=len(sets))
        contents: dict[int, frozenset] = {}
        postings: dict[int, list[int]] = {}
        holder: dict[int, int] = {}
        accepted = np.zeros(len(seq), dtype=bool)

        def content(s: int) -> frozenset:
            if s not in contents:
                contents[s] = frozenset(tokens[s].as_py())
            return contents[s]

        for i in range(len(seq)):
            l, s = int(lid[i]), int(of_set[i])
            if l in latest:
                old = latest[l]
                if not has_moment[i] or (old is not None and moment[i] <= old):
                    continue
            if s >= 0:
                if any(x != l for x in owners.get(int(sets[s]), ())) or holder.get(s, l) != l:
                    continue
                seen: set[int] = {s}
                refused = False
                for k in busy[begin[s] : end[s]]:
                    if use[k] & LOOK:
                        for other in postings.get(int(key[k]), ()):
                            if other not in seen:
                                seen.add(other)
                                if holder[other] != l and 2 * len(content(s) & content(other)) >= len(content(s) | content(other)):
                                    refused = True
                                    break
                    if refused:
                        break
                if refused:
                    continue
            accepted[i] = True
            if again[i] or l in latest:
                old = latest.get(l)
                latest[l] = old if not has_moment[i] else int(moment[i]) if old is None else max(old, int(moment[i]))
            if s >= 0 and s not in holder:
                if copies[s] > 1 or end[s] > begin[s]:
                    holder[s] = l
                for k in busy[begin[s] : end[s]]:
                    if use[k] & HERE:
                        postings.setdefault(int(key[k]), []).append(s)
        took = np.flatnonzero(accepted)
        held, one = np.unique(of_set[took], return_index=True)
        one, held = one[held >= 0], held[held >= 0]
        new = ~np.isin(sets[held], np.array(sorted(known), dtype=np.int64))
        held, one = held[new], took[one[new]]
        yield from _sent(_to_store(seq[took], lid[took], rows.column("m").take(pa.array(took)), sets[held], lid[one], tokens.take(pa.array(held)), heat, buckets))

    return run


def _to_store(seq, lid, moment, setid, owner_lid, tokens, hot, buckets: int) -> list[pa.Table]:
    """Accepted rows, and their new sets, as rows for the buckets."""
    values, owner, sizes = flat_lists(tokens)
    at, key, use, own = set_keys(values, owner, sizes, hot)
    late = (use & LATER) > 0
    at, key, own = at[late], key[late], own[late]
    return [
        _flow(NEW_ROW, bucket_of(seq, buckets), seq),
        _flow(NEW_LISTING, bucket_of(lid, buckets), lid, m=moment),
        _flow(NEW_SET, bucket_of(setid, buckets), setid, owner_lid, tokens=tokens),
        _flow(NEW_FINGERPRINT, bucket_of(key, buckets), key, setid[at], sizes[at] * np.where(own, 1, -1)),
    ]


def _accepted_to_store(hot, buckets: int):
    """:func:`_to_store` over a table of accepted rows, whose set is NULL where the store has it."""

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            sets = t.filter(t.column("setid").is_valid())
            tokens = sets.column("tokens").combine_chunks() if sets.num_rows else pa.array([], pa.list_(pa.int64()))
            yield from _sent(_to_store(_column(t, "seq"), _column(t, "lid"), t.column("moment"), _column(sets, "setid"), _column(sets, "lid"), tokens, hot, buckets))

    return run


def _write(root: str, states: list[str | None], split: bool, tag: str, limit: int):
    """In the task of a bucket: add what is new to its runs and its filter, and report its new state."""

    def run(batches):
        t = _gathered(batches)
        folder, buckets = Folder(root), len(states)
        for b in np.unique(_column(t, "bucket")):
            mine = t.filter(pa.array(_column(t, "bucket") == b))
            kind = _column(mine, "kind")
            part = lambda k, *pick: mine.filter(pa.array(kind == k)).select(pick)
            counts = [sum(part(COUNTS, c).column(c).to_pylist()) for c in "abcm"]
            bucket = Bucket(folder, states[b])
            bucket.clean()

            def whole(run: pa.Table) -> pa.Table:
                return run.filter(pa.array(bucket_of(_column(run, run.column_names[0]), buckets) == b)) if split else run

            def sorted_once(run: pa.Table) -> pa.Table:
                run = whole(run)
                order = np.lexsort([_column(run, c) for c in reversed(run.column_names[: 2 if "k" in run.column_names else 1])])
                run = run.take(pa.array(order))
                first = _column(run, run.column_names[0])
                new = np.r_[True, first[1:] != first[:-1]] if len(first) else np.empty(0, dtype=bool)
                if "k" in run.column_names and len(first):
                    second = _column(run, "setid")
                    new |= np.r_[True, second[1:] != second[:-1]]
                return run.filter(pa.array(new))

            fresh = part(NEW_FINGERPRINT, "a", "b", "c").rename_columns(["k", "setid", "n"])
            fresh = fresh.set_column(2, "n", fresh.column("n").cast(pa.int32()))
            listings = part(NEW_LISTING, "a", "m").rename_columns(["lid", "moment"])
            label = f"{b:05d}-{tag}"
            merged = bucket.add("fingerprints", label, fresh, sorted_once, split)
            bucket.add("listings", label, listings, lambda run: _newest(whole(run)), split)
            bucket.add("sets", label, part(NEW_SET, "a", "b", "tokens").rename_columns(["setid", "lid", "tokens"]), sorted_once, split)
            bucket.add("rows", label, part(NEW_ROW, "a").rename_columns(["seq"]), sorted_once, split)
            hot, grown = part(HOT, "a").column("a").to_pylist(), []
            if merged is not None:
                k, n = np.unique(_column(merged, "k")[_column(merged, "n") > 0], return_counts=True)
                grown = k[n > limit].tolist()
            state = bucket.state
            keys = np.unique(np.concatenate([_column(fresh, "k"), _listing_key(_column(listings, "lid"))]))
            bits = np.frombuffer(folder.get(state["filter"]), dtype=np.uint8).copy() if state["filter"] and not split else None
            if bits is not None:
                keys = keys[~bloom.may_hold(bits, keys)]
            if state["filter"]:
                state["garbage"].append(state["filter"])
            if bits is None or state["keys"] + len(keys) > state["size"]:
                every = [_column(x, "k") for x in bucket.everything("fingerprints", ["k"])] + [_listing_key(_column(x, "lid")) for x in bucket.everything("listings", ["lid"])]
                keys = np.unique(np.concatenate([keys, *every]))
                state["keys"], state["size"] = 0, max(1024, 2 * len(keys))
                bits = bloom.empty_bits(state["size"])
            bloom.put(bits, keys)
            state["keys"] += len(keys)
            state["filter"] = folder.new_name("filters", label, "bin")
            folder.put(state["filter"], bits.tobytes())
            name = bucket.save(label)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([name]), pa.array([state["keys"]]), *[pa.array([v], pa.list_(pa.int64())) for v in (hot, grown, counts)]],
                names=["bucket", "state", "keys", "hot", "grown", "counts"],
            )

    return run


class AcceptedStore:
    """A persistent store of accepted rows in a shared folder, fed by :meth:`ingest`; opening a folder goes on where its last manifest ended."""

    def __init__(self, spark: SparkSession, root: str | None = None, settle_rows: int = SETTLE_ROWS, hot_sets: int = HOT_SETS, bucket_keys: int = BUCKET_KEYS):
        self.spark, self.root, self.settle_rows, self.hot_sets, self.bucket_keys = spark, root or work_path(spark, "accepted"), settle_rows, hot_sets, bucket_keys
        self.folder = Folder(self.root)
        self.manifest = {"ingests": 0, "through": None, "keys": 0, "states": [None] * LEAST_BUCKETS, "hot": None, "counts": [0, 0, 0, 0]}
        if names := self.folder.names("manifest"):
            self.manifest = json.loads(self.folder.get(names[-1]))
        self.hot = self._hot()

    def _hot(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.manifest["hot"]:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        pairs = np.frombuffer(self.folder.get(self.manifest["hot"]), dtype=np.int64).reshape(2, -1)
        return pairs[0], pairs[1]

    def accepted(self) -> DataFrame:
        """(seq) of all rows accepted so far."""
        root, states = self.root, self.manifest["states"]

        def read(batches):
            folder = Folder(root)
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    for run in Bucket(folder, states[b]).everything("rows") if states[b] else []:
                        yield from run.to_batches()

        return self.spark.range(len(states), numPartitions=len(states)).mapInArrow(read, "seq long")

    def screening(self) -> dict[str, float]:
        """Over all ingests: keys screened, let through and found, the share of absent keys let through, and rows of runs read."""
        keys, passed, found, read = self.manifest["counts"]
        return {"keys": keys, "passed": passed, "found": found, "false_share": (passed - found) / max(1, keys - found), "rows_read": read}

    def _commit(self, done: list, through: int) -> None:
        m = dict(self.manifest, states=list(self.manifest["states"]))
        for r in done:
            m["states"][r["bucket"]] = r["state"]
        m["ingests"] += 1
        m["through"] = through
        m["keys"] = sum(r["keys"] for r in done)
        m["counts"] = [x + sum(r["counts"][i] for r in done) for i, x in enumerate(m["counts"])]
        before = len(self.hot[0])
        # What was hot as the batch came in, then what grew hot in the store: its postings of this batch are still under its own key.
        for name, epoch in (("hot", 2 * self.manifest["ingests"]), ("grown", 2 * self.manifest["ingests"] + 1)):
            self.hot = _with_hot(self.hot, np.unique(np.concatenate([np.array(r[name], dtype=np.int64) for r in done])), epoch)
        if len(self.hot[0]) > before:
            m["hot"] = self.folder.new_name("hot", f"{m['ingests']:08d}", "bin")
            self.folder.put(m["hot"], np.stack(self.hot).tobytes())
        self.folder.commit(f"manifest/{m['ingests']:08d}.json", json.dumps(m).encode())
        self.manifest = m
        for old in self.folder.names("manifest")[:-2]:
            self.folder.drop(old)

    def ingest(self, batch: DataFrame, size: dict | None = None) -> None:
        """Take one batch of :func:`prepared` rows, all later than those of earlier batches.

        Rows up to the last one that a manifest names are passed over, so a
        batch whose ingest died can be given again.  ``size`` has the number of
        rows ``n`` and the ``first`` and ``last`` seq if they are known.
        """
        batch = batch.select("seq", "lid", "moment", "setid", "tokens")
        through = self.manifest["through"]
        if through is not None and (size is None or size["first"] <= through):
            batch, size = batch.where(F.col("seq") > through), None
        size = size or batch.agg(F.count("*").alias("n"), F.max("seq").alias("last")).first()
        if not size["n"]:
            return
        if size["n"] <= self.settle_rows:
            self._take(batch, size["n"], size["last"])
            return
        waves, step = [], max(1, self.settle_rows)
        while (sum(waves) + step) < size["n"]:
            waves.append(step)
            step *= 2
        ends = sorted({int(x) for x in batch.approxQuantile("seq", [sum(waves[: i + 1]) / size["n"] for i in range(len(waves))], 0.001)}) + [size["last"]]
        low = -1
        for high in ends:
            part = batch.where((F.col("seq") > low) & (F.col("seq") <= high))
            if n := part.count():
                self._take(part, n, high)
            low = high

    def _take(self, batch: DataFrame, rows: int, last: int) -> None:
        m, root, now = self.manifest, self.root, self.manifest["ingests"]
        states, split = list(m["states"]), False
        while max(m["keys"], 12 * rows) > self.bucket_keys * len(states) * 2:
            states, split = states * 2, True
        buckets, tag = len(states), f"{now:06d}"
        limit = max(self.hot_sets, (m["keys"] + 12 * rows) // HOT_BOUND)
        by_bucket = lambda df: df.repartitionById(buckets, "bucket")
        probes = by_bucket(batch.mapInArrow(_probes(self.hot, buckets), FLOW_SCHEMA))
        evidence = by_bucket(probes.mapInArrow(_find(root, states), FLOW_SCHEMA)).mapInArrow(_verify(root, states), FLOW_SCHEMA)
        row = batch.select(F.lit(0).alias("bucket"), F.lit(ROW).alias("kind"), F.col("seq").alias("a"), F.col("lid").alias("b"), F.col("setid").alias("c"), F.col("moment").alias("m"), "tokens")
        touch = self.spark.range(0, buckets, 1, 1).selectExpr("cast(id as int) bucket", f"{TOUCH} kind", "0L a", "0L b", "0L c", "0L m", "cast(null as array<long>) tokens")
        if rows <= self.settle_rows:
            every = row.unionByName(evidence) if now else row
            new = every.repartition(1).mapInArrow(_settle(self.hot, now, limit, buckets), FLOW_SCHEMA)
        else:
            new = self._settle_rounds(batch, stored(evidence, "evidence") if now else None, buckets, limit)
        done = by_bucket(new.unionByName(touch)).mapInArrow(_write(root, states, split, tag, limit), DONE_SCHEMA).collect()  # one row a bucket
        self.manifest = dict(m, states=states)
        self._commit(done, last)

    def _settle_rounds(self, batch: DataFrame, evidence: DataFrame | None, buckets: int, limit: int) -> DataFrame:
        """As :func:`_settle`, in distributed rounds.

        Rows equal in listing, moment and photos to an earlier one are refused
        whatever becomes of that one, since what speaks against it speaks
        against them.
        """
        now = self.manifest["ingests"]
        rows = batch.groupBy("lid", "moment", "setid").agg(F.min("seq").alias("seq"))
        tokens = batch.where("setid is not null").groupBy("setid").agg(F.first("tokens").alias("tokens"))
        known = None
        if evidence is not None:
            late = evidence.where(f"kind = {LATEST}").select(F.col("a").alias("lid"), F.col("m").alias("latest"), F.lit(True).alias("listed"))
            owners = evidence.where(f"kind = {OWNER}").groupBy(F.col("a").alias("setid")).agg(F.min(F.least("b", "c")).alias("o1"), F.max(F.greatest("b", "c")).alias("o2"), F.max("m").alias("same"))
            known = owners.where("same = 1").select("setid", F.lit(True).alias("stored"))
            bad = (F.col("listed") & (F.col("moment").isNull() | F.coalesce(F.col("moment") <= F.col("latest"), F.lit(False)))) | (F.col("o1") != F.col("lid")) | (F.col("o2") != F.col("lid"))
            rows = rows.join(late, "lid", "left").join(owners, "setid", "left").where(~F.coalesce(bad, F.lit(False))).select("seq", "lid", "moment", "setid")
        rows = stored(rows, "open")
        sets = stored(rows.where("setid is not null").select("setid").distinct().join(tokens, "setid"), "open-sets")
        found = sets.select(F.explode("tokens").alias("t")).groupBy("t").count().where(F.col("count") > limit).select("t").collect()  # at most HOT_BOUND by the limit
        fresh = np.setdiff1d(_photo_key(np.array([r["t"] for r in found], dtype=np.int64)), self.hot[0])
        hot = _with_hot(self.hot, fresh, 2 * now)

        def here(batches):
            for b in batches:
                values, owner, sizes = flat_lists(b.column("tokens"))
                at, key, use, _ = set_keys(values, owner, sizes, hot)
                setid = b.column("setid").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, setid[at], sizes[at].astype(np.int32), (use & LOOK) > 0, (use & HERE) > 0)], names=["k", "setid", "n", "look", "here"])

        keyed = sets.mapInArrow(here, "k long, setid long, n int, look boolean, here boolean")
        a, b = keyed.where("look").alias("a"), keyed.where("here").alias("b")
        fits = (F.col("a.setid") != F.col("b.setid")) & (2 * F.col("a.n") >= F.col("b.n")) & (2 * F.col("b.n") >= F.col("a.n"))
        pairs = a.join(b, F.col("a.k") == F.col("b.k")).where(fits).select(F.col("a.setid").alias("a"), F.col("b.setid").alias("b")).distinct()
        one, two = sets.select(F.col("setid").alias("a"), F.col("tokens").alias("t1")), sets.select(F.col("setid").alias("b"), F.col("tokens").alias("t2"))
        common = F.size(F.array_intersect("t1", "t2"))
        near = pairs.join(one, "a").join(two, "b").where(common >= SHARE * (F.size("t1") + F.size("t2") - common)).select("a", "b")
        ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        own = sets.select(F.col("setid").alias("a"), F.col("setid").alias("b"))
        links = stored(near.select(ways.alias("w")).select("w.a", "w.b").unionByName(own).distinct(), "links")
        state = stored(rows.withColumn("st", F.lit(0)), "state")
        earlier = w.Window.partitionBy("lid").orderBy("seq").rowsBetween(w.Window.unboundedPreceding, -1)
        two = w.Window.partitionBy("setid", "st").orderBy("s")
        for _ in range(10_000):
            for st, name in ((1, "sure"), (0, "open")):
                state = state.withColumn(name, F.max(F.when(F.col("st") == st, F.coalesce("moment", F.lit(-(1 << 62))))).over(earlier))
            speaks = lambda c: F.coalesce(F.col("moment").isNull() & F.col(c).isNotNull() | (F.col("moment") <= F.col(c)), F.lit(False))
            # Of the rows of a set, the two earliest of different listings say it all.
            least = state.where("st < 2 and setid is not null").groupBy("setid", "st", "lid").agg(F.min("seq").alias("s")).withColumn("_r", F.row_number().over(two)).where("_r <= 2")
            against = (
                state.where("st = 0").select("seq", F.col("lid").alias("own"), F.col("setid").alias("a")).join(links, "a")
                .join(least.select(F.col("setid").alias("b"), "s", "lid", F.col("st").alias("by")), "b")
                .where((F.col("s") < F.col("seq")) & (F.col("lid") != F.col("own")))
                .groupBy("seq").agg(F.max("by").alias("by"))
            )
            step = state.join(against, "seq", "left").select(
                "seq", "lid", "moment", "setid",
                F.when(F.col("st") > 0, F.col("st")).when(speaks("sure") | F.coalesce(F.col("by") == 1, F.lit(False)), 2).when(speaks("open") | (F.col("by") == 0), 0).otherwise(1).alias("st"),
            )
            state = stored(step, "state")
            if state.where("st = 0").isEmpty():
                break
        else:
            raise RuntimeError("rows did not settle")
        taken = state.where("st = 1")
        first = w.Window.partitionBy("setid").orderBy("seq")
        fresh_sets = taken.where("setid is not null").withColumn("_r", F.row_number().over(first)).where("_r = 1").select("seq", "setid")
        if known is not None:
            fresh_sets = fresh_sets.join(known, "setid", "left_anti")
        ready = taken.drop("setid", "st").join(fresh_sets.join(sets, "setid"), "seq", "left").select("seq", "lid", "moment", "setid", "tokens")
        new = ready.mapInArrow(_accepted_to_store(hot, buckets), FLOW_SCHEMA)
        if evidence is not None:
            new = new.unionByName(evidence.where(f"kind = {COUNTS}"))
        if len(fresh):
            new = new.unionByName(self.spark.createDataFrame([(0, HOT, int(k), None, None, None, None) for k in fresh], FLOW_SCHEMA))
        return new


def refused_rows(rows: DataFrame, root: str | None = None, **settings) -> DataFrame:
    """(row_no) of rows that repeat accepted earlier ones, batch by batch.

    ``rows``: row_no (unique, below 2 ** 40), batch_no, listing_id, updated_at,
    photos.  Each batch is one ingest into the store at ``root`` (a new one if
    that is missing); ``settings`` go to :class:`AcceptedStore` and change no
    result.

    A row is refused if an accepted earlier row has its listing and it has no
    readable moment, or one not later than that row's; or if an accepted
    earlier row of another listing shares at least half of all distinct photos
    of both.  A missing moment of the accepted row refuses nothing by itself.
    A NULL ``batch_no`` comes before all others.  An empty table gives an
    empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    ready = prepared(rows)
    sizes = ready.groupBy("batch").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")).collect()  # one row a batch
    if not sizes:
        return ready.select("row_no").limit(0)
    pieces = F.lit(1)
    for r in sizes:
        if r["n"] > FILE_ROWS:
            pieces = F.when(F.col("batch") == r["batch"], F.lit(-(-r["n"] // FILE_ROWS))).otherwise(pieces)
    files = sum(-(-r["n"] // FILE_ROWS) for r in sizes)
    path = work_path(spark, "batches")
    ready.withColumn("_piece", F.pmod(F.xxhash64("row_no"), pieces)).repartition(min(files, 4 * spark.sparkContext.defaultParallelism + files // 8), "batch", "_piece").drop("_piece").write.partitionBy("batch").parquet(path)
    store = AcceptedStore(spark, root, **settings)
    schema = ready.drop("batch").schema
    for r in sorted(sizes, key=lambda r: r["batch"]):
        store.ingest(spark.read.schema(schema).parquet(f"{path}/batch={r['batch']}"), r.asDict())
    every = spark.read.schema(ready.schema).parquet(path)
    # The size of what was accepted grows with the rows and isn't known to the planner: never broadcast it.
    return every.select("row_no", "seq").join(store.accepted().hint("merge"), "seq", "left_anti").select("row_no")


#: Rows of one file of a batch that waits for its ingest.
FILE_ROWS = 200_000
