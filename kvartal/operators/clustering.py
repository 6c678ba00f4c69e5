"""Contiguous clusters of cells: Ward linkage along a contiguity graph."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.functions.geo import haversine_km
from kvartal.operators.components import connected_components


def ward_labels(x: np.ndarray, edges: np.ndarray, clusters: int) -> np.ndarray:
    """Labels from 0 of ``clusters`` contiguous groups: the cheapest adjacent pair by Ward's cost is merged until so many are left."""
    n = len(x)
    centre, size = {i: x[i].astype(float) for i in range(n)}, dict.fromkeys(range(n), 1)
    near: dict[int, set[int]] = {i: set() for i in range(n)}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    parent = list(range(n))
    cost = lambda a, b: size[a] * size[b] / (size[a] + size[b]) * float(((centre[a] - centre[b]) ** 2).sum())
    heap = [(cost(a, b), a, b) for a in near for b in near[a] if a < b]
    heapq.heapify(heap)
    left, new = n, n
    while left > clusters and heap:
        _, a, b = heapq.heappop(heap)
        if a not in centre or b not in centre:
            continue
        total = size[a] + size[b]
        centre[new] = (centre[a] * size[a] + centre[b] * size[b]) / total
        size[new] = total
        near[new] = (near[a] | near[b]) - {a, b}
        for k in near[new]:
            near[k] -= {a, b}
            near[k].add(new)
        parent += [new]
        parent[a] = parent[b] = new
        for k in (a, b):
            del centre[k], size[k], near[k]
        for k in near[new]:
            heapq.heappush(heap, (cost(min(k, new), max(k, new)), min(k, new), max(k, new)))
        left, new = left - 1, new + 1
    roots: dict[int, int] = {}
    out = np.empty(n, dtype=np.int64)
    for i in range(n):
        k = i
        while parent[k] != k:
            k = parent[k]
        out[i] = roots.setdefault(k, len(roots))
    return out


def share_out(sizes: list[int], total: int) -> list[int]:
    """Shares of ``total`` among components by size, at least one and at most the size each, by largest remainders."""
    total = max(total, len(sizes))
    exact = [1 + (total - len(sizes)) * s / sum(sizes) for s in sizes]
    out = [math.floor(e) for e in exact]
    order = sorted(range(len(sizes)), key=lambda i: (-(exact[i] - out[i]), i))
    for i in order[: total - sum(out)]:
        out[i] += 1
    return [min(o, s) for o, s in zip(out, sizes)]


def contiguous_clusters(cells: DataFrame, edges: DataFrame, features: list[str], clusters: int) -> DataFrame:
    """(h3, label): contiguous groups of cells alike in standardised ``features``.

    Each connected component is clustered on its own, with its share of the
    groups, so no group bridges a gap.  A component goes to one task: cells are
    units of analysis, thousands at most, not rows.
    """
    code = F.xxhash64("h3")
    moments = cells.agg(*[F.avg(c).alias("m_" + c) for c in features], *[F.stddev_pop(c).alias("s_" + c) for c in features]).first()
    scaled = cells.select("h3", code.alias("node"), *[((F.col(c) - F.lit(float(moments["m_" + c]))) / F.lit(float(moments["s_" + c]) if (moments["s_" + c] or 0) > 1e-12 else 1.0)).alias(c) for c in features])
    loops = scaled.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    known = edges.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"), F.col("src").alias("a"), F.col("dst").alias("b"))
    own = scaled.select("node")
    inner = known.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")
    groups = connected_components(inner.select("src", "dst").unionByName(loops))
    members = scaled.join(groups, "node")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.min("h3").alias("first")).orderBy(F.desc("n"), "first").collect()
    if not sizes:
        return cells.select("h3", F.lit(0).cast("long").alias("label")).limit(0)
    shares = share_out([r["n"] for r in sizes], clusters)
    start = np.concatenate([[0], np.cumsum(shares)])
    plan = {r["component"]: (k, int(s)) for r, k, s in zip(sizes, shares, start)}
    held = groups.select(F.col("node").alias("src"), F.col("component").alias("part"))
    links = inner.join(held, "src").select("part", "a", "b")

    def cluster(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("h3", ignore_index=True)
        k, first = plan[int(left["component"].iloc[0])]
        at = {c: i for i, c in enumerate(left["h3"])}
        pairs = np.array([(at[a], at[b]) for a, b in zip(right["a"], right["b"])], dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"h3": left["h3"], "label": first + ward_labels(left[features].to_numpy(), pairs, k)})

    return members.groupBy("component").cogroup(links.groupBy("part")).applyInPandas(cluster, "h3 string, label long")


def market_regions(listings: DataFrame, edges: DataFrame, regions: int, cutoff_month: str | None = None, cell: str = "cell") -> DataFrame:
    """(cell, region): contiguous regions of base cells alike in mean log price and share of new buildings, fitted on months before ``cutoff_month`` only."""
    rows = listings if cutoff_month is None else listings.where(F.col("listed_month") < cutoff_month)
    if rows.isEmpty():
        raise ValueError("no listings before the cutoff month")
    new = F.when(F.col("building_type") == "new", 1.0).otherwise(0.0)
    stats = rows.groupBy(F.col(cell).alias("h3")).agg(F.avg(F.ln("price_azn_m2")).alias("log_price"), F.avg(new).alias("new_share"))
    out = contiguous_clusters(stats, edges, ["log_price", "new_share"], regions)
    return out.select(F.col("h3").alias("cell"), F.format_string("mr:%04d", F.col("label")).alias("region"))


def assign_regions(points: DataFrame, membership: DataFrame, centres: DataFrame, cell: str = "cell", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``points`` with ``region``: that of their base cell, or of the nearest region centre for cells not seen when the regions were fitted.

    ``centres``: (cell, lat, lon) of the member cells; a region's centre is
    their mean.  Regions are few hundred by construction and are broadcast.
    """
    middles = membership.join(centres.select("cell", F.col("lat").alias("y"), F.col("lon").alias("x")), "cell").groupBy("region").agg(F.avg("y").alias("y"), F.avg("x").alias("x"))
    table = middles.agg(F.collect_list(F.struct("y", "x", "region")).alias("regions"))
    known = points.join(membership.select(F.col("cell").alias(cell), F.col("region").alias("_own")), cell, "left").crossJoin(F.broadcast(table))  # one row
    away = F.transform("regions", lambda r: F.struct(haversine_km(F.col(lat), F.col(lon), r["y"], r["x"]).alias("d"), r["region"].alias("region")))
    return known.select(*points.columns, F.coalesce("_own", F.array_min(away)["region"]).alias("region"))


def zone_features(boxes: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone, zone_name, feature): each zone as a GeoJSON MultiPolygon of its boxes, in [lon, lat] order with closed rings."""
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(corner("lon_min", "lat_min"), corner("lon_max", "lat_min"), corner("lon_max", "lat_max"), corner("lon_min", "lat_max"), corner("lon_min", "lat_min"))
    parts = zones.join(boxes.select("h3", F.array(ring).alias("polygon")), "h3").groupBy("zone", "zone_name").agg(F.sort_array(F.collect_list(F.struct("h3", "polygon"))).alias("p"))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.col("p.polygon").alias("coordinates"))
    return parts.select("zone", "zone_name", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct("zone", "zone_name").alias("properties"))).alias("feature"))


def region_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(src, dst) of regions with adjacent cells."""
    a = membership.select(F.col("cell").alias("src"), F.col("region").alias("ra"))
    b = membership.select(F.col("cell").alias("dst"), F.col("region").alias("rb"))
    return edges.join(a, "src").join(b, "dst").where("ra <> rb").select(F.col("ra").alias("src"), F.col("rb").alias("dst")).distinct()


def micro_zones(panel: DataFrame, centres: DataFrame, edges: DataFrame, most: int = 40, density_weight: float = 0.5) -> DataFrame:
    """(h3, zone, zone_name): contiguous zones of cells by place and by number of listings; the weight applies after scaling."""
    dense = panel.groupBy("h3").agg(F.log1p(F.sum("n_listings")).alias("density")).join(centres.select("h3", "lat", "lon"), "h3")
    m = dense.agg(F.avg("density").alias("m"), F.stddev_pop("density").alias("s"), F.stddev_pop("lat").alias("slat"), F.stddev_pop("lon").alias("slon"), F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon")).first()
    unit = lambda v: float(v) if v and v > 1e-12 else 1.0
    shaped = dense.select("h3", ((F.col("lat") - m["mlat"]) / unit(m["slat"])).alias("y"), ((F.col("lon") - m["mlon"]) / unit(m["slon"])).alias("x"), ((F.col("density") - m["m"]) / unit(m["s"]) * density_weight).alias("d"))
    labels = contiguous_clusters(shaped, edges, ["y", "x", "d"], most)
    return labels.select("h3", F.col("label").alias("zone"), F.format_string("Zone %d", F.col("label") + 1).alias("zone_name"))


def grown_blocks(edges: DataFrame, blocks: int) -> DataFrame:
    """(region, block) by growing contiguous blocks of regions breadth first; the last takes what is left.

    Regions are few hundred by construction, so this runs on the driver.
    """
    spark = edges.sparkSession
    near: dict[str, set[str]] = {}
    for r in edges.select("src", "dst").collect():
        near.setdefault(r["src"], set()).add(r["dst"])
        near.setdefault(r["dst"], set()).add(r["src"])
    left, out, b = set(near), [], 0
    target = max(1, len(left) // blocks)
    while left:
        cap = target if b < blocks - 1 else len(near)
        grown = [min(left)]
        left.discard(grown[0])
        i = 0
        while i < len(grown) and len(grown) < cap:
            for k in sorted(near[grown[i]] & left)[: cap - len(grown)]:
                left.discard(k)
                grown.append(k)
            i += 1
        out += [(r, f"blk:{min(b, blocks - 1)}") for r in grown]
        b += 1
    return spark.createDataFrame(out, "region string, block string")
