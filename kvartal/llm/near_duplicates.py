"""Near-duplicate records by filtering under several global token orders.

Two records can only share half of all their tokens if their prefixes share a
token, under every global order of tokens.  One order (rare tokens first, then
by a hash) makes the candidates by a join on its prefix tokens; two more orders
must agree, by bit masks of their prefixes, before a candidate is fetched and
verified exactly.

Copies are folded before: records equal in tokens and attributes are one
signature, and each listing of a signature is linked to it once.

A token held by very many signatures (a stock picture) leads to a prefix only
in small sets.  There it joins within cells of the attributes that both sides
have, and not across the whole token.  Whatever key still has more than
``SHARE_ROWS`` rows is joined in shares: each row of one side goes to one share,
those of the other side to all, so no task gets a whole key.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.llm.tokensets import flat_lists, hot_tokens, is_hot, mix, photo_keys, positions
from kvartal.operators.components import connected_components
from kvartal.sources.tables import stored

SHARE = 0.5
AREA_GAP = 0.05
PRICE_GAP = 0.10
LAT_GAP = 0.001
#: Rows of a key that one share of a join takes.
SHARE_ROWS = 2_000
#: Keys in shares up to which their table is broadcast.
BIG_KEYS = 100_000
KEY_SCHEMA = "k long, sid long, n int, mb long, mc long, l boolean, r boolean"


def prefix_length(sizes: np.ndarray, share: float = SHARE) -> np.ndarray:
    """Tokens of which one must be shared: size - ceil(share * size) + 1."""
    return sizes - np.ceil(share * sizes - 1e-9).astype(np.int64) + 1


def _masks(values, owner, sizes, cold_last, seed):
    """Per set, a 62-bit mask of its prefix under another order."""
    rank = positions(owner, cold_last, mix(values, seed))
    keep = rank < prefix_length(sizes)[owner]
    out = np.zeros(len(sizes), dtype=np.int64)
    np.bitwise_or.at(out, owner[keep], np.int64(1) << (mix(values[keep], 99) % np.uint64(62)).astype(np.int64))
    return out


def _cells(attr: np.ndarray, width: float, log: bool):
    """Numbers of the two half-shifted cells of a value; values closer than half a width share one. Nothing at or below zero meets anything above."""
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.log(attr) if log else attr
    x = np.where(np.isfinite(x), x, -1e6)
    return [np.floor(x / width).astype(np.int64) * 2, np.floor(x / width + 0.5).astype(np.int64) * 2 + 1]


def _hot_keys(at, token, area, price, lat):
    """Keys of hot prefix tokens: (row, key, left, right) by the first attribute that both sides have, of lat, area and price."""
    has = [~np.isnan(v[at]) for v in (lat, area, price)]
    grids = [(lat, 2 * LAT_GAP * (1 + 1e-9), False), (area, 2 * -math.log(1 - AREA_GAP) * (1 + 1e-9), True), (price, 2 * -math.log(1 - PRICE_GAP) * (1 + 1e-9), True)]
    lacks = [np.ones(len(at), dtype=bool), ~has[0], ~has[0] | ~has[1]]
    for kind, (v, width, log) in enumerate(grids):
        for cell in _cells(v[at], width, log):
            m = has[kind]
            yield at[m], mix(mix(token[m], 11 + kind).view(np.int64) ^ cell[m], 3), lacks[kind][m], np.ones(m.sum(), dtype=bool)
    mask = sum(h.astype(np.int64) << b for b, h in enumerate(has))
    for other in range(8):
        m = (mask & other) == 0
        yield at[m], mix(mix(token[m], 21).view(np.int64) ^ other, 3), np.ones(m.sum(), dtype=bool), np.zeros(m.sum(), dtype=bool)
    yield at, mix(mix(token, 21).view(np.int64) ^ mask, 3), np.zeros(len(at), dtype=bool), np.ones(len(at), dtype=bool)


def _keys(hot: np.ndarray):
    def rows(batches):
        for batch in batches:
            values, owner, sizes = flat_lists(batch.column("tokens"))
            heat = is_hot(values, hot)
            rank = positions(owner, heat, mix(values, 1))
            take = rank < prefix_length(sizes)[owner]
            mb, mc = (_masks(values, owner, sizes, heat, s) for s in (2, 5))
            attr = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("area", "price", "lat")]
            cold, warm = take & ~heat, take & heat
            parts = [(owner[cold], mix(values[cold], 3), np.ones(cold.sum(), dtype=bool), np.ones(cold.sum(), dtype=bool))]
            if warm.any():
                parts += list(_hot_keys(owner[warm], values[warm], *attr))
            at, key, left, right = (np.concatenate(x) for x in zip(*parts))
            sid = batch.column("sid").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (key.view(np.int64), sid[at], sizes[at].astype(np.int32), mb[at], mc[at], left, right)], names=["k", "sid", "n", "mb", "mc", "l", "r"]
            )

    return rows


def in_shares(left: DataFrame, right: DataFrame, key: str, member: str, share_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``key`` with a further column ``share`` to join on.

    Keys with more than ``share_rows`` (SHARE_ROWS) rows on the right are cut
    into shares by ``member``; the left rows of such a key are copied to all.
    """
    share_rows = share_rows or SHARE_ROWS
    big = stored(right.groupBy(key).count().where(F.col("count") > share_rows).select(key, F.ceil(F.col("count") / share_rows).cast("int").alias("shares")), "big-keys")
    number = big.count()
    if not number:
        return left.withColumn("share", F.lit(0)), right.withColumn("share", F.lit(0))
    big = F.broadcast(big) if number <= BIG_KEYS else big
    left = left.join(big, key, "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shares"), F.lit(1)) - 1))).drop("shares")
    right = right.join(big, key, "left").withColumn("share", F.pmod(F.xxhash64(member), F.coalesce(F.col("shares"), F.lit(1))).cast("int")).drop("shares")
    return left, right


def close(a: Column, b: Column, gap: float) -> Column:
    """Within ``gap`` of the larger value; a value missing on one side doesn't count against."""
    return F.coalesce(F.abs(a - b) <= gap * F.greatest(a, b), F.lit(True))


def alike_links(signatures: DataFrame) -> DataFrame:
    """Pairs of ``sid`` (s1 < s2) whose tokens share at least half and whose attributes are close.

    ``signatures``: sid, tokens (distinct), area, price, lat.  NULL attributes
    don't count against.  A signature without tokens has no pair.
    """
    hot = hot_tokens(signatures, "tokens")
    keys = signatures.select("sid", "tokens", "area", "price", "lat").mapInArrow(_keys(hot), KEY_SCHEMA)
    keys = stored(keys, "alike-keys")
    a, b = (side.alias(name) for side, name in zip(in_shares(keys.where("l"), keys.where("r"), "k", "sid"), "ab"))
    agree = (F.col("a.mb").bitwiseAND(F.col("b.mb")) != 0) & (F.col("a.mc").bitwiseAND(F.col("b.mc")) != 0)
    sizes = (F.col("a.n") >= SHARE * F.col("b.n")) & (F.col("b.n") >= SHARE * F.col("a.n"))
    pairs = (
        a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.share") == F.col("b.share")))
        .where((F.col("a.sid") != F.col("b.sid")) & sizes & agree)
        .select(F.least("a.sid", "b.sid").alias("s1"), F.greatest("a.sid", "b.sid").alias("s2"))
        .distinct()
    )
    one = signatures.select(*[F.col(c).alias(c + "1") for c in ("sid", "tokens", "area", "price", "lat")])
    two = signatures.select(*[F.col(c).alias(c + "2") for c in ("sid", "tokens", "area", "price", "lat")])
    both = pairs.join(one, F.col("s1") == F.col("sid1")).join(two, F.col("s2") == F.col("sid2"))
    common = F.size(F.array_intersect("tokens1", "tokens2"))
    near_lat = F.coalesce(F.abs(F.col("lat1") - F.col("lat2")) <= LAT_GAP, F.lit(True))
    return both.where(
        close(F.col("area1"), F.col("area2"), AREA_GAP) & close(F.col("price1"), F.col("price2"), PRICE_GAP) & near_lat
        & (common >= SHARE * (F.size("tokens1") + F.size("tokens2") - common))
    ).select("s1", "s2")


def near_duplicate_groups(rows: DataFrame) -> DataFrame:
    """(listing_id, component) of every listing that is alike to another one, directly or over others.

    ``rows``: listing_id, photos, area, price (in one unit), lat; several rows
    for a listing are its versions, each of which may be alike to a version of
    another.  Rows without photos or without a listing are alike to none; NaN
    counts as missing.  Repeated rows fold into one signature.  Listings and
    signatures are told apart by 64-bit hashes.  An empty table gives an empty
    result; other columns are ignored.
    """
    num = lambda c: F.when(~F.isnan(c), F.col(c)).cast("double").alias(c)
    parsed = stored(
        rows.where(F.col("listing_id").isNotNull())
        .select("listing_id", F.xxhash64("listing_id").alias("lid"), photo_keys(F.col("photos")).alias("tokens"), num("area"), num("price"), num("lat"))
        .where(F.size("tokens") > 0)
        .withColumn("sid", F.xxhash64("tokens", F.coalesce("area", F.lit(-9e99)), F.coalesce("price", F.lit(-9e99)), F.coalesce("lat", F.lit(-9e99)))),
        "alike-rows",
    )
    signatures = stored(
        parsed.groupBy("sid").agg(
            *[F.first(c).alias(c) for c in ("tokens", "area", "price", "lat")], F.min("lid").alias("rep"), F.max("lid").alias("other")
        ),
        "alike-signatures",
    )
    links = alike_links(signatures)
    reps = signatures.select("sid", "rep")
    far = (
        links.join(reps.select(F.col("sid").alias("s1"), F.col("rep").alias("src")), "s1")
        .join(reps.select(F.col("sid").alias("s2"), F.col("rep").alias("dst")), "s2")
        .where("src <> dst")
        .select("src", "dst")
    )
    shared = signatures.where("rep <> other").select("sid", "rep")
    same = parsed.select("sid", "lid").join(shared, "sid").where("lid <> rep").select(F.col("lid").alias("src"), F.col("rep").alias("dst"))
    groups = connected_components(far.unionByName(same))
    names = parsed.select("lid", "listing_id").distinct()
    return names.join(groups, names["lid"] == groups["node"]).select("listing_id", "component")


def pairs_within(groups: DataFrame, share_rows: int | None = None) -> DataFrame:
    """All pairs of listings of a group, the smaller first; large groups are joined in shares."""
    a, b = in_shares(groups, groups, "component", "listing_id", share_rows)
    a = a.select(F.col("component").alias("c1"), F.col("share").alias("s1"), F.col("listing_id").alias("listing_id_a"))
    b = b.select(F.col("component").alias("c2"), F.col("share").alias("s2"), F.col("listing_id").alias("listing_id_b"))
    return a.join(b, (F.col("c1") == F.col("c2")) & (F.col("s1") == F.col("s2")) & (F.col("listing_id_a") < F.col("listing_id_b"))).select("listing_id_a", "listing_id_b")
