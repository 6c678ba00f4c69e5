import collections

import numpy as np
import pyarrow as pa
import pytest

from kvartal.llm import bloom
from kvartal.llm import history_dedup as hd
from kvartal.llm.history_dedup import AcceptedStore, prepared, refused_rows
from kvartal.llm.runs import FAN, Bucket, Folder
from kvartal.sources.tables import work_path

SCHEMA = "row_no long, batch_no int, listing_id string, updated_at string, photos array<string>, seq string"


def photo(k):
    return f"https://a.example/full/{k:016x}.jpg"


def brute(rows):
    accepted, out = [], set()
    for r, b, lid, at, photos, _ in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[0])):
        s, m = frozenset(photos or []), (int(at) if at and at.isdigit() else None)
        lid = lid if lid is not None else ("no listing", r)
        bad = any(l == lid and (m is None or (n is not None and m <= n)) for l, n, _ in accepted)
        bad = bad or any(l != lid and s and len(s & t) * 2 >= len(s | t) for l, _, t in accepted)
        if bad:
            out.add(r)
        else:
            accepted.append((lid, m, s))
    return out


def rows(n, seed, batches=6):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.45:
            _, _, lid, at, photos, _ = out[rng.integers(len(out))]
            lid = lid if rng.random() < 0.5 else f"L{rng.integers(90)}"
            at = at if rng.random() < 0.3 else str(1_700_000_000 + int(rng.integers(-500, 500)))
            if photos and rng.random() < 0.5:
                photos = [*photos[1:], photo(int(rng.integers(1, 300)))]
        else:
            lid, at = f"L{rng.integers(90)}", str(1_700_000_000 + int(rng.integers(-500, 500)))
            photos = [photo(int(k)) for k in rng.integers(1, 300, rng.integers(0, 7))]
            if i % 5 == 0:
                photos = [photo(7), photo(8)][: 1 + i % 2] + [photo(int(k)) for k in rng.integers(1, 300, i % 3)]  # stock pictures
            if i % 7 == 0:
                photos = [photo(7), photo(8), photo(9), photo(10)][: 2 + i % 3] + [photo(int(k)) for k in rng.integers(1, 300, i % 2)]
        out.append((i * 3, None if i < n // 20 else 1 + i * batches // n, None if i % 41 == 7 else lid, None if i % 17 == 3 else at, None if i % 29 == 4 else photos, "clash"))
    return out


@pytest.mark.parametrize("seed,batches,settings", [(1, 6, {}), (2, 14, {"hot_sets": 4}), (3, 3, {"hot_sets": 4, "settle_rows": 20, "bucket_keys": 60}), (4, 1, {"settle_rows": 30, "hot_sets": 1000})])
def test_matches_the_sequential_rule(spark, seed, batches, settings):
    data = rows(240, seed, batches)
    got = [r["row_no"] for r in refused_rows(spark.createDataFrame(data, SCHEMA), **settings).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)


def test_hot_photos_among_several_batches(spark):
    rng = np.random.default_rng(9)
    data = []
    for i in range(300):
        some = [photo(int(k)) for k in rng.choice(6, int(rng.integers(1, 5)), replace=False) + 1] + [photo(int(k)) for k in rng.integers(100, 160, rng.integers(0, 3))]
        data.append((i, 1 + i // 30, f"L{i % 120}", str(1_700_000_000 + i), sorted(set(some)), None))
    got = {r["row_no"] for r in refused_rows(spark.createDataFrame(data, SCHEMA), hot_sets=3).collect()}
    assert got == brute(data)


def test_copies_of_one_picture(spark):
    data = [(i, 1 + i // 60, f"L{i % 50}", str(1_700_000_000 + i), [photo(5)], None) for i in range(120)]
    got = {r["row_no"] for r in refused_rows(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == brute(data)


def test_versions_of_one_listing(spark):
    data = [(i, 1 + i // 100, "L", str(1_700_000_000 + (i * 37) % 90), [photo(i)], None) for i in range(200)]
    for settings in ({}, {"settle_rows": 25}):
        got = {r["row_no"] for r in refused_rows(spark.createDataFrame(data, SCHEMA), **settings).collect()}
        assert got == brute(data)


def feed(store, table, batches):
    for b in batches:
        store.ingest(table.where(f"batch = {b}"))


def test_store_is_reopened_and_a_died_ingest_is_given_again(spark, monkeypatch):
    data = rows(200, 5, 4)
    table = prepared(spark.createDataFrame(data, SCHEMA)).cache()
    root = work_path(spark, "reopened")
    feed(AcceptedStore(spark, root), table, [0, 2])
    first = AcceptedStore(spark, root)
    assert first.manifest["ingests"] == 2
    feed(first, table, [0, 2])  # given again, nothing changes
    assert first.manifest["ingests"] == 2

    def dies(self, done, through):
        raise RuntimeError("killed before its manifest")

    with monkeypatch.context() as m:
        m.setattr(AcceptedStore, "_commit", dies)
        with pytest.raises(RuntimeError):
            feed(first, table, [3])
    again = AcceptedStore(spark, root)
    assert again.manifest["ingests"] == 2
    feed(again, table, [3, 4, 5])
    accepted = {r["seq"] for r in AcceptedStore(spark, root).accepted().collect()}
    refused = {r["row_no"] for r in table.collect() if r["seq"] not in accepted}
    table.unpersist()
    assert refused == brute(data)


def test_filters_stay_sharp_and_reads_stay_small(spark):
    n, batches = 3000, 30
    data = [(i, 1 + i * batches // n, f"L{i}", str(1_700_000_000 + i), [photo(10 * i + 1000 + k) for k in range(5)], None) for i in range(n)]
    store = AcceptedStore(spark, work_path(spark, "sharp"))
    table = prepared(spark.createDataFrame(data, SCHEMA)).cache()
    feed(store, table, range(2, batches + 2))
    table.unpersist()
    seen = store.screening()
    assert store.accepted().count() == n and seen["found"] == 0 and seen["keys"] > 3 * n
    assert seen["false_share"] < 0.01 and seen["rows_read"] < 60 * n
    runs = Bucket(Folder(store.root), store.manifest["states"][0]).state["runs"]
    assert all(len(r) < FAN * 3 for r in runs.values())


def test_lookup_reads_only_row_groups_around_the_keys(tmp_path):
    folder = Folder("file://" + str(tmp_path))
    folder.write_run("x/run.parquet", pa.table({"k": np.arange(0, 200_000, 2), "v": np.arange(100_000)}))
    found, read = folder.lookup("x/run.parquet", np.array([10, 11, 120_000]))
    assert found.column("k").to_pylist() == [10, 120_000] and read == 2 * 8192
    assert folder.lookup("x/run.parquet", np.array([-5, 300_000])) == (None, 0)


def test_empty(spark):
    assert refused_rows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bloom_forgets_nothing_and_rarely_invents():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**62), 2**62, 5000)
    bits = bloom.empty_bits(5000)
    bloom.put(bits, keys[:2000])
    bloom.put(bits, keys[2000:])
    assert bloom.may_hold(bits, keys).all() and bloom.may_hold(bits, rng.integers(-(2**62), 2**62, 20000)).mean() < 0.01
    assert bloom.may_hold(bits, np.empty(0, dtype=np.int64)).size == 0


def test_shared_counts():
    a, b = pa.array([[1, 2, 3], [4]], pa.list_(pa.int64())), pa.array([[2, 3], [], [4, 9]], pa.list_(pa.int64()))
    assert hd.shared_counts(a, b, np.array([0, 0, 1, 1]), np.array([0, 1, 2, 0])).tolist() == [2, 0, 1, 0]


def test_counts_by_rule():
    assert collections.Counter(bool(x) for x in brute(rows(50, 3)))
