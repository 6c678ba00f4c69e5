import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kvartal.llm.packing import best_fit, meetings, pack
from kvartal.llm.page_spam import spam_pages
from kvartal.llm.quantile_sketch import Sketch, partial_sketches, percentiles_by_batch, sketch_percentiles
from kvartal.llm.tokens import decode, encoding, token_ids

TEXTS = ["", None, " ", "Mənzil satılır.\n\n\n  Ünvan: 5-ci   mərtəbə", "word" * 900, "a\n\n\nb" * 200, "  \n" * 300 + "end", "It's 42 000 ₼ 🏠🌊 in Bakı city " * 60, "x\r\n\ty 'll we've 's" * 80, "!" * 700, "тест " * 300 + "​" * 50]


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (256, 40), (8192, 512)])
def test_ids_are_those_of_the_whole_text(spark, chunk, overlap):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in token_ids(df, chunk=chunk, overlap=overlap).collect()}
    e = encoding()
    assert got == {i: e.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert all(decode(ids) == (TEXTS[i] or "").encode() for i, ids in got.items())


def test_no_documents(spark):
    assert token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sweep_rows", [50_000, 400])
def test_packing(spark, sweep_rows):
    rng = np.random.default_rng(0)
    sizes = [int(s) for s in np.r_[rng.integers(0, 300, 900), [5] * 500, 4096, 2048, 2049, 7000]]
    df = spark.createDataFrame([(i, s, 1) for i, s in enumerate(sizes)] + [(9000, None, 1), (9001, -4, 1)], "id long, n int, container_id int")
    out = pack(df, "id", "n", 2048, sweep_rows).toPandas()
    real = out[out.n_size > 0]
    fill = real.groupby("container_id").n_size.sum()
    assert fill.max() <= 2048 and sorted(fill.index) == list(range(len(fill)))
    assert len(fill) <= -(-sum(sizes) // 2048) + 1
    whole = real.groupby("id").agg(n=("n_size", "sum"), pieces=("piece_no", "size"))
    assert all(whole.n[i] == s and whole.pieces[i] == (1 if s <= 2048 else -(-s // 2048)) for i, s in enumerate(sizes) if s)
    none = out[out.n_size <= 0]
    assert set(none.id) == {i for i, s in enumerate(sizes) if s == 0} | {9000, 9001} and none.container_id.isna().all()


def test_packing_nothing_and_repeats(spark):
    schema = "id long, n int"
    assert pack(spark.createDataFrame([], schema), "id", "n", 10).count() == 0
    out = pack(spark.createDataFrame([(1, 6), (1, 6), (1, 6)], schema), "id", "n", 10).collect()
    assert sorted(r["container_id"] for r in out) == [0, 1, 2]


def plain_best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_one_sweep_is_plain_best_fit():
    sizes = sorted(np.random.default_rng(3).integers(1, 100, 500).tolist(), reverse=True)
    containers, gaps, aside, opened = best_fit(sizes, [], 1, 0, 100)
    assert opened == plain_best_fit(sizes, 100) and (np.bincount(containers, sizes) <= 100).all() and not aside


def test_those_left_over_meet_by_rank():
    got = meetings([0, 3, 2, 4], [2, 4, 0, 9])
    assert got == [(1, 0, 2, 0, 0), (2, 0, 2, 1, 0), (3, 0, 2, 1, 2)]
    slots = [(q, first + i) for _, _, n, q, first in got for i in range(n)]
    assert len(slots) == len(set(slots))


@pytest.mark.parametrize("capacity,low,high", [(10**7, 10**5, 6 * 10**6), (1000, 1, 400), (100, 34, 50)])
def test_rounds_fill_as_well_as_best_fit(spark, capacity, low, high):
    rng = np.random.default_rng(capacity)
    sizes = rng.integers(low, high, 3000).tolist() + [high] * 1000
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, n long")
    out = pack(df, "id", "n", capacity, 700).toPandas()
    fill = out.groupby("container_id").n_size.sum()
    best = plain_best_fit(sizes, capacity)
    assert len(out) == len(sizes) and set(out.id) == set(range(len(sizes))) and fill.max() <= capacity and sorted(fill.index) == list(range(len(fill)))
    assert len(fill) <= best + max(2, best // 200)


def test_sketch_error_is_bounded():
    rng = np.random.default_rng(1)
    values = np.r_[rng.lognormal(0, 2, 60_000), np.full(20_000, 3.0)]
    rng.shuffle(values)
    whole, parts = Sketch(64, 4), [Sketch(64, 4) for _ in range(7)]
    whole.add(values)
    for p, v in zip(parts, np.array_split(values, 7)):
        p.add(v)
    merged = Sketch(64, 4)
    for p in parts:
        merged.merge(*p.parts(), p.n, p.err)
    order = np.sort(values)
    for s in (whole, merged):
        assert s.n == len(values) and s.err <= 0.08 * s.n
        for share, got in zip((0.0, 0.1, 0.5, 0.9, 1.0), s.quantiles([0.0, 0.1, 0.5, 0.9, 1.0])):
            rank = max(1, int(np.ceil(share * len(values))))
            low, high = np.searchsorted(order, got, "left") + 1, np.searchsorted(order, got, "right")
            assert max(low - rank, rank - high, 0) <= s.err + 4**6


def test_percentiles_by_batch(spark):
    rng = np.random.default_rng(2)
    n = 6000
    d = pd.DataFrame({"batch_no": rng.integers(0, 5, n), "h3": rng.choice(["hot", "a", None], n, p=[0.8, 0.1, 0.1]), "v": np.round(rng.normal(0, 9, n), 1), "n": 1})
    d.loc[::13, "v"] = None
    df = spark.createDataFrame(d.astype({"h3": object}), "batch_no long, h3 string, v double, n long")
    exact = d.dropna(subset="v").fillna({"h3": ""}).groupby("h3").v.apply(lambda v: np.sort(v)[int(np.ceil(len(v) / 2)) - 1]).to_dict()
    got = {r["h3"] or "": r for r in percentiles_by_batch(df.withColumn("v", F.when(F.col("batch_no") == 9, float("nan")).otherwise(F.col("v"))), ["h3"], "batch_no", "v", {"p50": 0.5}).collect()}
    assert set(got) == set(exact)
    for k, r in got.items():
        v = np.sort(d[(d.h3.fillna("") == k) & d.v.notna()].v)
        at = np.searchsorted(v, [r["p50"]], "right")[0], np.searchsorted(v, [r["p50"]], "left")[0] + 1
        assert r["n_values"] == len(v) and at[1] - len(v) / 2 - 1 <= r["rank_error"] and len(v) / 2 - at[0] <= r["rank_error"] + 1
    assert sketch_percentiles(partial_sketches(df.limit(0), ["h3"], "v"), ["h3"], {"p50": 0.5}).count() == 0


def test_spam_pages(spark):
    prose = "Bina komitəsi keçən payız ilk qiymətdən imtina etdi, bu da qonşuları təəccübləndirdi. Ən yaxın dayanacağa piyada 5 dəqiqəyə çatmaq mümkündür. Həyət gözətçisi yağışdan sonra darvazanın yanında ağac əkdi, çünki yol təzəcə açılmışdı."
    spam = {
        1: "ucuz mənzil, satılıq ev, ofis 48m2, kirayə ev, " * 12, 2: "#villa #ucuzmənzil #satılıqev " * 15, 3: "https://kvadrat.invalid/ev/1 bestflat.example/plot/2 " * 10, 4: "Best deals here is best deals for best deals. " * 10,
        5: "\n".join(f"{i}. ucuz mənzil ✅" for i in range(30)), 6: '<a href="http://x.example/a">satılıq ev</a>\n' * 9, 7: prose[:80] + ".\n" + "garage! Garage GARAGE garage " * 20, 8: "MƏNZIL ALQI-SATQISI KIRAYƏ EV OFIS " * 20,
    }
    fair = {
        20: prose, 21: prose.upper(), 22: prose + "\n#villa #ofis #qaraj", 23: "• Sahə: 171 m²\n• Qiymət: 350,700 AZN\n• Rayon: Qumluq\n• Mərtəbə: 4/9", 24: "Qoşaqala | 2 | 78 m² | 5070\nQızılüzən | 2 | 116 m² | 5600\nLimanaltı | 1 | 163 m² | 3260",
        25: (prose + " ") * 400, 26: "It sits on floor 8 of a 12-storey building and the windows look over a park.", 27: "", 28: None, 29: "  \n ", 30: "?!… --",
    }
    rows = [(i, t, ["az", "XX", None][i % 3], "clash") for i, t in {**spam, **fair}.items()]
    got = {r["doc_id"] for r in spam_pages(spark.createDataFrame(rows, "doc_id long, text string, lang string, spam_share string")).collect()}
    assert got == set(spam)
    assert spam_pages(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_spam_pages_whole_page(spark):
    az = ["ucuz mənzil satılıq ev kirayə ofis qaraj torpaq villa bağ otaq bina lift təmir kredit.", "yeni tikili ipoteka obyekt mağaza anbar studiya penthaus hovuz həyət park metro mərkəz sahil bulvar.", "günlük icarə həftəlik qonaq mehmanxana hostel döşək mebel kombi mətbəx balkon eyvan parket laminat kafel."]
    ru = "Купить квартиру продажа аренда дом дача участок офис гараж недорого срочно."
    salted = "villa with pool villa near sea villa in centre villa for family villa at park and cheap villa on coast to order villa from owner."
    spam = {1: "\n".join(az * 30), 2: " ".join(az * 30), 3: az[0], 4: ru, 5: "Cheap flat sale rent villa office garage land house studio Baku centre.", 6: "\n".join([ru] * 20), 7: " ".join([salted.replace("pool", w) for w in ("pool", "lift", "garage", "yard")] * 5)}
    prose = "Bina komitəsi keçən payız ilk qiymətdən imtina etdi, bu da qonşuları təəccübləndirdi. Ən yaxın dayanacağa piyada 5 dəqiqəyə çatmaq mümkündür. Həyət gözətçisi yağışdan sonra darvazanın yanında ağac əkdi, çünki yol təzəcə açılmışdı."
    fair = {
        20: "Çinarlı Düz qəsəbəsində 5 otaqlı mənzil satılır, ümumi sahəsi 79 kvadratmetrdir.", 21: "Кухня отдельная, около 22 метров, покупателю остаётся кондиционер.", 22: "Qiymət 501 200 manatdır, real alıcıya cüzi güzəşt oluna bilər.",
        23: "PALIDKƏND SEMTINDE 2 ODALI DAIRE SATILIKTIR. DAIRE YENILENDI.", 24: "\n".join([prose] * 30), 25: prose + "\n" + az[0],
    }
    got = {r["doc_id"] for r in spam_pages(spark.createDataFrame([(i, t, "ru" if i == 21 else None) for i, t in {**spam, **fair}.items()], "doc_id long, text string, lang string")).collect()}
    assert got == set(spam)


def test_sketch_keys_keep_their_type(spark):
    from datetime import datetime
    from decimal import Decimal

    at = datetime(2026, 1, 2, 3, 4, 5)
    rows = [(1.5, 2**60 + 1, at, "a", Decimal("1.10"), 1.0), (1.7, 2**60 + 3, at, "a", Decimal("1.20"), 2.0), (float("nan"), None, None, None, None, 3.0), (float("nan"), None, None, None, None, 5.0), (-0.0, 7, at, "", None, 1.0), (0.0, 7, at, "", None, 9.0)]
    df = spark.createDataFrame(rows, "f double, i long, t timestamp, s string, d decimal(9,2), v double").repartition(3)
    n = lambda keys: {tuple("nan" if k != k else k for k in (r[c] for c in keys)): r["n_values"] for r in sketch_percentiles(partial_sketches(df, keys, "v"), keys, {"p50": 0.5}).collect()}
    assert n(["f"]) == {(1.5,): 1, (1.7,): 1, ("nan",): 2, (0.0,): 2}
    assert n(["i"]) == {(2**60 + 1,): 1, (2**60 + 3,): 1, (None,): 2, (7,): 2}
    assert n(["t", "s"]) == {(at, "a"): 2, (None, None): 2, (at, ""): 2}
    assert n(["d", "i"]) == {(Decimal("1.10"), 2**60 + 1): 1, (Decimal("1.20"), 2**60 + 3): 1, (None, None): 2, (None, 7): 2}


def test_sketch_is_the_same_again_and_near_with_other_partitions(spark):
    from pyspark.sql import functions as F

    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("b"), F.rand(7).alias("v"))
    data = df.toPandas()

    def run(parts):
        cut = spark.createDataFrame(data).repartitionByRange(parts, "v") if parts > 1 else spark.createDataFrame(data).coalesce(1)
        return {r["g"]: (r["p50"], r["rank_error"]) for r in percentiles_by_batch(cut, ["g"], "b", "v", {"p50": 0.5}, size=32, fan=4).collect()}

    one, again, other = run(1), run(1), run(4)
    assert one == again
    for g, (v, err) in other.items():
        mine = data[data["g"] == g]["v"]
        for value, bound in ((v, err), one[g]):
            assert 0 < bound < 0.2 * len(mine) and abs((mine <= value).sum() - len(mine) / 2) <= bound + 1


def test_kept_batches_are_not_read_again(spark):
    from kvartal.sources.tables import work_path

    root = work_path(spark, "kept")
    first = spark.createDataFrame([("a", 1, 1.0), ("a", None, 5.0)], "g string, b int, v double")
    again = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 9.0), ("b", 2, 2.0)], "g string, b int, v double")
    ask = lambda df: {r["g"]: (r["p50"], r["n_values"]) for r in percentiles_by_batch(df, ["g"], "b", "v", {"p50": 0.5}, root).collect()}
    assert ask(first) == {"a": (1.0, 2)}
    assert ask(again) == {"a": (5.0, 3), "b": (2.0, 1)}
    assert ask(again.limit(0)) == {"a": (5.0, 3), "b": (2.0, 1)}
