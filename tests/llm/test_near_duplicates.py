import collections
import re

import numpy as np
import pytest

from kvartal.llm.near_duplicates import alike_links, near_duplicate_groups, pairs_within, prefix_length
from kvartal.llm.tokensets import hot_tokens, photo_keys

SCHEMA = "listing_id string, photos array<string>, area double, price double, lat double, tokens string"


def address(key, style):
    return [f"https://a.example/full/{key[:2]}/{key}.jpg", f"//b.example/u/{key.upper()}_l.jpeg", f"https://c.example/i?file={key}&w=80"][style % 3]


def keys_of(photos):
    return [m.group(0) for p in photos or [] if p and (m := re.search("[0-9a-f]{16}", p.lower()))]


def alike(a, b):
    ka, kb = frozenset(keys_of(a[1])), frozenset(keys_of(b[1]))
    common = len(ka & kb)
    if not common or 2 * common < len(ka | kb):
        return False
    for i, gap in ((2, 0.05), (3, 0.10)):
        if a[i] is not None and b[i] is not None and abs(a[i] - b[i]) > gap * max(a[i], b[i]):
            return False
    return a[4] is None or b[4] is None or abs(a[4] - b[4]) <= 0.001


def brute(rows):
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[0] and b[0] and a[0] != b[0] and alike(a, b):
                parent[find(a[0])] = find(b[0])
    groups = collections.defaultdict(list)
    for v in list(parent):
        groups[find(v)].append(v)
    return {(a, b) for g in groups.values() for a in g for b in g if a < b}


def rows(n=260, seed=1):
    rng = np.random.default_rng(seed)
    keys = [f"{int(k):016x}" for k in rng.integers(0, 2**63, 400)]
    hot = keys[:2]
    out = []
    for i in range(n):
        if i % 3 == 0 and out:
            src = out[rng.integers(len(out))]
            ks = list(dict.fromkeys(keys_of(src[1])))
            if len(ks) > 1 and rng.random() < 0.6:
                ks = ks[:-1] + [keys[rng.integers(400)]]
            vals = [None if v is None or rng.random() < 0.1 else float(v * rng.uniform(0.94, 1.06)) for v in src[2:4]]
            lat = None if src[4] is None else float(src[4] + rng.choice([0, 0.0009, 0.0011]))
        else:
            ks = [keys[j] for j in rng.integers(2, 400, rng.integers(0, 8))]
            vals, lat = [float(rng.uniform(40, 60)), float(rng.uniform(9e4, 1.1e5))], float(np.round(40 + rng.integers(0, 9) * 0.0007, 4))
            if i % 4 == 1:
                ks = [hot[i % 2]] if i % 8 == 1 else [*hot, *ks[:1]]
            vals = [None if rng.random() < 0.15 else v for v in vals]
            lat = None if rng.random() < 0.15 else lat
        photos = None if i % 37 == 5 else [address(k, i + j) for j, k in enumerate(ks)] + ([address(ks[0], i)] if ks and i % 5 == 0 else [])
        out.append((f"L{i if i % 10 else max(0, i - 10)}", photos, *vals, lat, "clash"))
    return out + [(None, [address(keys[5], 0)], 50.0, 1e5, 40.0, None), out[3], out[3], ("bad", ["https://x.example/no-key.jpg", None], float("nan"), None, None, None)]


@pytest.mark.parametrize("least,share_rows", [(64, 2000), (64, 3), (6, 2)])
def test_matches_brute_force(spark, monkeypatch, least, share_rows):
    import kvartal.llm.near_duplicates as m

    monkeypatch.setattr(m, "SHARE_ROWS", share_rows)
    monkeypatch.setattr(m, "hot_tokens", lambda sets, column: hot_tokens(sets, column, least))
    data = rows(seed=least)
    got = [tuple(r) for r in pairs_within(near_duplicate_groups(spark.createDataFrame(data, SCHEMA))).collect()]
    want = brute([(a, b, *[None if v is not None and v != v else v for v in c]) for a, b, *c in data])
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_copies_of_one_set_under_many_listings(spark):
    key = address("00000000000000aa", 0)
    data = [(f"L{i:03d}", [key], 50.0, 1e5, 40.0, None) for i in range(150)] + [(f"M{i:03d}", [key], 50.0 * 1.2**i, 1e5, 40.0, None) for i in range(1, 10)]
    groups = near_duplicate_groups(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(groups) == 150 and len({r["component"] for r in groups}) == 1
    table = spark.createDataFrame(groups)
    for share_rows in (2000, 40):
        got = [tuple(r) for r in pairs_within(table, share_rows).collect()]
        assert len(got) == len(set(got)) == 150 * 149 // 2


def test_empty(spark):
    assert pairs_within(near_duplicate_groups(spark.createDataFrame([], SCHEMA))).count() == 0
    assert near_duplicate_groups(spark.createDataFrame([("a", None, None, None, None, None), ("b", [], 1.0, 1.0, 1.0, None)], SCHEMA)).count() == 0
    assert alike_links(spark.createDataFrame([], "sid long, tokens array<bigint>, area double, price double, lat double")).count() == 0


def test_prefixes_and_keys(spark):
    assert prefix_length(np.arange(1, 9)).tolist() == [1, 2, 2, 3, 3, 4, 4, 5]
    got = spark.createDataFrame([(["https://a/F000000000000001/x.jpg", "//b/u/f000000000000001_l.jpeg", "https://c/no.jpg", None],), (None,), ([],)], "photos array<string>").select(photo_keys("photos").alias("k")).collect()
    assert [len(r["k"]) for r in got] == [1, 0, 0] and got[0]["k"][0] == 0xF000000000000001 - 2**64
