import random
import statistics

import pytest
from pyspark.sql import functions as F

from recfeat.operators import assemble, enrich, negatives, profile, sampling, split
from recfeat.tables import as_bucketed

from .conftest import SMALL, rows

REVIEW = "user_id string, parent_asin string, rating double, sort_timestamp long, row_key string, main_category string, price_cents long, review_title string, review_text string"


def made(n=120, users=3, seed=1, span=400):
    rng = random.Random(seed)
    day = 24 * 3600 * 1000
    return [
        (
            f"u{rng.randrange(users)}", f"i{rng.randrange(25)}", float(rng.randrange(1, 6)), rng.choice([None, rng.randrange(1, span) * day, 7 * day]), f"r{k:04}",
            rng.choice(["a", "b", "c", None, ""]), rng.choice([None, rng.randrange(100, 5000)]), f"t{k}", rng.choice([None, f"x{k}"]),
        )
        for k in range(n)
    ]


def walked(data):
    """The rule, row by row."""
    out = {}
    users = {}
    for r in sorted(data, key=lambda r: (r[0], -1 if r[3] is None else r[3], r[4])):
        u = users.setdefault(r[0], {"n": 0, "cats": {}, "prices": [], "hist": [], "seen": set()})
        n, prices = u["n"], u["prices"]
        out[r[4]] = {
            "pos": n + 1, "cnt": n, "hist": list(u["hist"][-3:]), "shares": {c: k / n for c, k in u["cats"].items()},
            "mean": statistics.fmean(prices) if prices else None, "std": statistics.stdev(prices) if len(prices) > 1 else 0.0,
        }
        u["n"] += 1
        name = r[5] or "UNK"
        u["cats"][name] = u["cats"].get(name, 0) + 1
        if r[6] is not None:
            prices.append(r[6] / 100)
        u["hist"].append((r[7], r[8]))
        u["seen"].add(r[1])
        out[r[4]]["seen"] = set(u["seen"])
    return out


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_profile_equals_the_walk(spark, parts):
    data = made()
    want = walked(data)
    df = profile.ordered(spark.createDataFrame(data, REVIEW).repartition(parts))
    assert profile.ordered(df.drop("ts_key", "pos"), 30 * 24 * 3600 * 1000).exceptAll(df).count() == 0
    got = [r for chunk in (128, 3, 7) for r in profile.user_features(df, chunk).withColumn("order", F.map_keys("user_feat.cat_hist")).collect()]
    assert len(got) == 3 * len(data)
    for r in got:
        w, f = want[r.row_key], r.user_feat
        assert (r.pos, f.review_cnt, [tuple(h) for h in f.history]) == (w["pos"], w["cnt"], w["hist"])
        assert f.price_mean == (None if w["mean"] is None else pytest.approx(w["mean"], abs=6e-5)) and f.price_std == pytest.approx(w["std"], abs=6e-5)
        assert r.order == list(w["shares"]) and f.cat_hist == pytest.approx(w["shares"], abs=6e-5)


def test_a_user_with_very_many_rows_in_a_day(spark, monkeypatch):
    """No window holds many more rows than the bound, whatever shares a user, a day or a time; positions stay those of one order."""
    n, most = 200_000, 5_000
    same = F.when(F.col("id") % 3 == 0, 1_600_000_000_000).otherwise(1_600_000_000_000 + F.col("id") * 100 % 86_400_000)  # a third at one time
    user = F.when(F.col("id") % 50 == 0, F.concat(F.lit("u"), F.col("id") % 7)).otherwise("bot")
    df = spark.range(n).select(user.alias("user_id"), F.when(F.col("id") % 11 != 0, same).alias("sort_timestamp"), F.md5(F.col("id").cast("string")).alias("row_key"))
    held = []
    kept = profile.as_table

    def watched(table, name):
        made = kept(table, name)
        if name == "blocks":
            held.append(made.agg(F.max("n")).first()[0])
        return made

    monkeypatch.setattr(profile, "as_table", watched)
    got = profile.ordered(df, most=most)
    by = {}
    for r in got.select("user_id", "ts_key", "row_key", "pos").collect():
        by.setdefault(r.user_id, []).append(tuple(r)[1:])
    assert sum(map(len, by.values())) == n
    for mine in by.values():
        assert [p for *_, p in sorted(mine)] == list(range(1, len(mine) + 1))
    assert held[0] > 100_000 and held[-1] < 2.5 * most


def test_worked_example(spark):
    data = [("u", "i", 5.0, t, f"r{t}", c, p, "t", "x") for t, c, p in ((1, "a", 1000), (2, "b", None), (3, "a", 2000), (4, "a", 1))]
    last = profile.user_features(profile.ordered(spark.createDataFrame(data, REVIEW))).where("pos = 4").first().user_feat
    assert (last.cat_hist, last.review_cnt, last.price_mean, last.price_std) == ({"a": 0.6667, "b": 0.3333}, 3, 15.0, 7.0711)
    first = profile.user_features(profile.ordered(spark.createDataFrame(data, REVIEW))).where("pos = 1").first().user_feat
    assert (first.cat_hist, first.review_cnt, first.price_mean, first.price_std, first.history) == ({}, 0, None, 0.0, [])


def test_shares_round_half_to_even(spark):
    data = [("u", "i", 5.0, t, f"r{t:03}", "b" if t == 1 else "a", None, "", "") for t in range(1, 34)]
    for chunk in (128, 32, 8):
        row = profile.category_shares(profile.ordered(spark.createDataFrame(data, REVIEW)), chunk).where("pos = 33").first()
        assert [tuple(x) for x in row.shares] == [("b", 0.0312), ("a", 0.9688)]


def test_negatives(spark):
    data = made(200, users=4)
    want = walked(data)
    df = profile.ordered(spark.createDataFrame(data, REVIEW))
    pool = negatives.candidate_pool(spark.createDataFrame([(f"i{k}",) for k in range(25)] * 2 + [(None,)], "parent_asin string"), size=20, seed=3)
    assert pool.count() == 20 and sorted(r.idx for r in pool.collect()) == list(range(20))
    items = {r.parent_asin for r in pool.collect()}
    got = negatives.draw_negatives(df, pool, 5, seed=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.row_key, []).append(r.neg_asin)
    for key, w in want.items():
        drawn = by.get(key, [])
        assert len(drawn) == len(set(drawn)) == min(5, len(items - w["seen"]))
        assert not set(drawn) & w["seen"] and set(drawn) <= items
    again = negatives.draw_negatives(df.repartition(7), pool, 5, seed=3)
    assert rows(again) == sorted((tuple(r) for r in got), key=repr)
    for chunk in (3, 7):  # what earlier chunks have seen comes as bitmaps
        assert rows(negatives.draw_negatives(df, pool, 5, seed=3, chunk=chunk)) == sorted((tuple(r) for r in got), key=repr)


def test_negatives_of_a_user_who_has_seen_nearly_all(spark):
    """Draws never fail: all but three items seen, exactly these three come out."""
    n = 400
    data = [("u", f"i{k:03}", 5.0, k, f"r{k:03}", "a", 1, "", "") for k in range(n - 3)] + [("u", "elsewhere", 5.0, n + k, f"s{k}", "a", 1, "", "") for k in range(300)]
    pool = negatives.candidate_pool(spark.createDataFrame([(f"i{k:03}",) for k in range(n)], "parent_asin string"))
    got = negatives.draw_negatives(profile.ordered(spark.createDataFrame(data, REVIEW)), pool, 5).collect()
    by = {}
    for r in got:
        by.setdefault(r.row_key, set()).add(r.neg_asin)
    assert all(by[f"s{k}"] == {"i397", "i398", "i399"} for k in range(300))
    assert all(len(by[f"r{k:03}"]) == min(5, n - 1 - k) and min(by[f"r{k:03}"]) > f"i{k:03}" for k in range(n - 3))


def test_negatives_are_uniform(spark):
    """Chi-square over the 40 items that two users have not seen, for each draw apart and all together."""
    data = [(u, f"i{k}", 5.0, 0, f"{u}{k}", "a", 1, "", "") for u in "ab" for k in range(10)] + [(u, "none", 5.0, 1 + k, f"{u}z{k}", "a", 1, "", "") for u in "ab" for k in range(2000)]
    pool = negatives.candidate_pool(spark.createDataFrame([(f"i{k}",) for k in range(50)], "parent_asin string"))
    got = negatives.draw_negatives(profile.ordered(spark.createDataFrame(data, REVIEW)), pool, 5).where("row_key like '_z%'").collect()
    for some in ([r for r in got if r.nth == 1], [r for r in got if r.nth == 5], got):
        counts = [sum(r.neg_asin == f"i{k}" for r in some) for k in range(50)]
        assert sum(counts[:10]) == 0
        mean = len(some) / 40
        assert sum((c - mean) ** 2 / mean for c in counts[10:]) < 72.1  # 39 degrees of freedom, one in a thousand


def test_negatives_and_profile_read_a_dealt_table_without_a_shuffle(spark):
    df = profile.chunked(profile.ordered(spark.createDataFrame(made(), REVIEW)))
    table = as_bucketed(df, "dealt", "user_id", "chunk")
    plan = lambda made_: made_._jdf.queryExecution().executedPlan().toString()
    by_user = lambda text: [line for line in text.split("\n") if "Exchange hashpartitioning(user_id" in line and "chunk" in line]
    assert by_user(plan(profile.numeric_profile(df))) and not by_user(plan(table.groupBy("user_id", "chunk").count()))
    pool = negatives.candidate_pool(spark.createDataFrame([(f"i{k}",) for k in range(25)], "parent_asin string"))
    text = plan(negatives.draw_negatives(table, pool, 5))
    assert "LeftAnti" not in text and "SelectedBucketsCount" in text
    spans = text.split("collect_list")[-1].split("Exchange")[0]  # what the rows' cells are built from
    assert "FileScan parquet" in spans


def test_small_and_empty_pools(spark):
    data = [("u", "i1", 5.0, 1, "a", "c", 1, "", ""), ("u", "i2", 5.0, 2, "b", "c", 1, "", "")]
    df = profile.ordered(spark.createDataFrame(data, REVIEW))
    pool = negatives.candidate_pool(spark.createDataFrame([("i1",), ("i2",), ("i3",)], "parent_asin string"))
    got = {(r.row_key, r.neg_asin) for r in negatives.draw_negatives(df, pool, 5).collect()}
    assert got == {("a", "i2"), ("a", "i3"), ("b", "i3")}  # a later purchase is not excluded
    assert negatives.draw_negatives(df, pool.limit(0), 5).count() == 0


def test_labels_dates_and_splits(spark):
    reviews = spark.createDataFrame(
        [("u", "i", r, t, f"k{n}") for n, (r, t) in enumerate([(None, 1), (3.9, None), (4.0, 0), (5.0, 1688169599999), (5.0, 1688169600000)])],
        "user_id string, parent_asin string, rating double, sort_timestamp long, row_key string",
    )
    meta = enrich.least_row(spark.createDataFrame([("i", "B"), ("i", "A"), ("j", "C")], "parent_asin string, main_category string"), "parent_asin")
    got = rows(enrich.enrich(reviews, meta).select("row_key", "main_category", "event_date", "label_good", "label_best", split.split_of(F.col("event_date"))))
    assert got == [
        ("k1", "A", None, 0, 0, "test"), ("k2", "A", None, 1, 0, "test"), ("k3", "A", "2023-06-30", 1, 1, "train"), ("k4", "A", "2023-07-01", 1, 1, "valid"),
    ]


def test_split_is_a_partition_and_routes_null_categories(spark):
    pos = spark.createDataFrame([("2023-01-01", None, 0), ("2023-08-01", "c", 0), (None, "c", 0)], "event_date string, main_category string, is_neg int")
    neg = spark.createDataFrame([("2024-01-01", "d", 1)], "event_date string, main_category string, is_neg int")
    both = split.split_rows(pos, neg)
    assert rows(both.select("split", "main_category", "is_neg")) == [("test", "c", 0), ("test", "d", 1), ("train", "UNK", 0), ("valid", "c", 0)]
    assert split.split_rows(pos, neg, drop_null_category=True).count() == 3
    p, n = split.parts(both)
    assert (p.count(), n.count(), "is_neg" in p.columns) == (3, 1, False)


def test_thinning_keeps_a_share(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(3.0).alias("rating"))
    kept = enrich.thin_top_ratings(df, "k", seed=1)
    assert kept.where("rating = 3").count() == 2500 and 400 < kept.where("rating = 5").count() < 600
    assert rows(kept) == rows(enrich.thin_top_ratings(df.repartition(5), "k", seed=1))


def test_workers_partition_the_samples(spark):
    df = spark.range(1000).withColumn("w", sampling.worker_of("id", 8))
    assert df.groupBy("w").count().count() == 8 and df.where("w is null or w < 0 or w > 7").count() == 0
    a, b = ([r.id for r in sampling.shuffled(spark.range(1000), "id", e, parts=3).collect()] for e in (1, 2))
    assert sorted(a) == sorted(b) == list(range(1000)) and a != b


def test_patch_join_and_validity(spark):
    items = spark.createDataFrame([("a", 1, 1, "x", "y"), ("b", 0, 0, " ", "y"), (" ", 0, 0, "x", "y"), ("c", 2, 0, "x", "y"), ("d", None, 0, "x", "y")], "parent_asin string, label_good int, label_best int, user_text string, item_text string")
    patches = spark.createDataFrame([("a", b"2"), ("a", b"1"), ("z", b"3")], "parent_asin string, patch binary")
    joined = assemble.with_patches(items, patches)
    assert [(r.parent_asin, r.patch and bytes(r.patch), r.has_image) for r in joined.orderBy("parent_asin").collect()] == [("a", b"1", 1), ("b", None, 0), ("c", None, 0), ("d", None, 0)]
    assert [r.parent_asin for r in assemble.valid(joined).collect()] == ["a"]


def test_empty_inputs(spark):
    df = profile.ordered(spark.createDataFrame([], REVIEW))
    assert profile.user_features(df).count() == 0


def test_buffer_shuffle_equals_a_plain_loop(spark):
    parts, n, size = 3, 4000, 64
    df = spark.range(0, n, 1, parts).withColumn("p", F.spark_partition_id())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        got = sampling.buffered(df, epoch=1, seed=7, size=size).collect()
        other = sampling.buffered(df, epoch=2, seed=7, size=size).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for p in range(parts):
        came = [r.id for r in df.where(F.col("p") == p).orderBy("id").collect()]
        draw, buffer, want = sampling.draws(7, 1, p), [], []
        for row in came:
            if len(buffer) < size:
                buffer.append(row)
            else:
                at = int(draw.integers(0, size))
                want.append(buffer[at])
                buffer[at] = row
        want += [buffer[i] for i in draw.permutation(len(buffer))]
        mine = [r.id for r in got if r.p == p]
        assert mine == want and sorted(mine) == came and mine != [r.id for r in other if r.p == p]
        assert all(at >= came.index(x) - size for at, x in enumerate(mine))
    assert sampling.buffered(df.limit(0), 1).count() == 0
    assert sorted(r.id for r in sampling.buffered(spark.range(0, 50, 1, 2), 1).collect()) == list(range(50))  # fewer rows than the buffer holds


def test_a_query_orders_only_the_columns_it_uses(spark, monkeypatch):
    """Positives go through several shuffles: what a query does not use stays behind, and users of few rows are in no table of blocks."""
    from recfeat.plans import adapters

    written, kept = {}, profile.as_table
    monkeypatch.setattr(profile, "as_table", lambda df, name: written.setdefault(name, kept(df, name)))
    table = adapters.ordered(spark, SMALL, "price_cents")
    assert table.columns == ["user_id", "pos", "chunk", "price_cents"]
    assert written["to_order"].columns == ["user_id", "row_key", "sort_timestamp", "price_cents"]
    assert written["crowded"].count() == written["blocks"].count() == 0


def test_samples_read_positions_from_a_table_and_shares_once(spark):
    """Joins and order are not computed anew for each part of the profile, nor the shares for each place in the text."""
    from recfeat.plans import features

    plan = features.model_samples(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
    plan = features.user_text(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries") == 1


def test_negatives_meet_their_metadata_without_a_shuffle(spark):
    from recfeat.plans import features

    plan = features.split_rows(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(neg_asin" not in plan and "SortMergeJoin [neg_asin" not in plan


def test_a_crowded_user_beside_null_and_small_ones(spark):
    """Users beyond the bound, of which one is null, are numbered in blocks, others at once."""
    data = [(None if k % 3 == 0 else "big" if k % 3 == 1 else f"u{k % 20}", k % 7 or None, f"r{k:04}") for k in range(900)]
    got = profile.ordered(spark.createDataFrame(data, "user_id string, sort_timestamp long, row_key string"), block_ms=3, most=50).collect()
    assert len(got) == 900
    by = {}
    for r in got:
        by.setdefault(r.user_id, []).append((r.ts_key, r.row_key, r.pos))
    assert all([p for *_, p in sorted(mine)] == list(range(1, len(mine) + 1)) for mine in by.values())


def test_rows_are_dealt_once_and_a_profile_reads_them_where_they_lie(spark):
    """Users of many rows are lots of one chunk, all others one lot; positions are those of a sort, and nothing is shuffled after the one deal."""
    from recfeat.plans import adapters

    from .conftest import SMALL

    made = [(f"u{i % 7 if i % 3 else 0}", f"k{i * 37 % 1000:04}", (i * 91 % 50) * 86_400_000 * 30 if i % 11 else None, i % 40, f"c{i * i % 13}") for i in range(1000)]
    source = spark.createDataFrame(made, "user_id string, row_key string, sort_timestamp long, price_cents long, main_category string")
    got, keys, n = profile.dealt(source, most=200, rows_per_part=100)
    assert keys == ["user_id", "lot"] and n == 10
    want = {}
    for user in {m[0] for m in made}:
        mine = sorted((m for m in made if m[0] == user), key=lambda m: (-1 if m[2] is None else m[2], m[1]))
        for i, m in enumerate(mine):
            chunk = i // profile.CHUNK
            want[m[1]] = (user, chunk + 1 if len(mine) > 200 else 0, i + 1, chunk, list({x[4]: None for x in mine[:i]}))
    assert {r.row_key: (r.user_id, r.lot, r.pos, r.chunk) for r in got.collect()} == {k: v[:4] for k, v in want.items()}
    shares = profile.category_shares(got).collect()
    assert {r.row_key: [e.category for e in r.shares] for r in shares} == {k: v[4] for k, v in want.items()}
    alone, keys, _ = profile.dealt(source, most=1000)
    assert keys == ["user_id"] and {r.row_key: (r.pos, r.chunk) for r in alone.collect()} == {k: v[2:4] for k, v in want.items()}
    shares = profile.category_shares(alone).collect()
    assert {r.row_key: [e.category for e in r.shares] for r in shares} == {k: v[4] for k, v in want.items()}
    assert alone.drop("ts_key")._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    wide = profile.user_features(adapters.ordered(spark, SMALL, "row_key", "price_cents", "main_category", "review_title", "review_text"))
    assert "Exchange " not in wide._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sent", [1_000_000, 10])
def test_sales_are_not_shuffled_by_item_while_items_are_few(spark, monkeypatch, sent):
    """However small Spark's own bound for broadcasts; with more items than ``ITEMS_SENT`` the rows are the same."""
    from recfeat.plans import adapters

    monkeypatch.setattr(adapters, "ITEMS_SENT", sent)
    used = ("user_id", "row_key", "price_cents", "main_category")
    want = adapters.positives(spark, SMALL).select(*used)
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = adapters.positives(spark, SMALL, *used)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin [parent_asin" in plan) == (sent > 10) and rows(got) == rows(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


def test_draws_of_a_chunk_equal_a_plain_loop():
    """All rows of a chunk at once: ranks among what is left, shifted one number after the other, also where less is left than is wanted."""
    import hashlib

    import numpy as np

    rng = random.Random(5)
    for n_pool, n_rows in ((0, 3), (1, 4), (7, 9), (12, 30), (300, 128)):
        keys = [f"k{rng.random()}" for _ in range(n_rows)]
        numbers = [rng.choice([-1, rng.randrange(n_pool)]) if n_pool else -1 for _ in keys]
        for seen in (None, {k for k in range(n_pool) if rng.random() < 0.3}):
            bits = None if seen is None else np.packbits(np.array([k in seen for k in range(64 * 8)]), bitorder="little").tobytes()
            got = negatives._unseen(negatives._words(keys, 5, 9), np.array(numbers), bits, n_pool)
            gone = sorted(seen or ())
            for key, number, line in zip(keys, numbers, got.tolist()):
                gone = sorted({*gone, number} - {-1})
                mine, want = gone, []
                for nth in range(5):
                    d = int(hashlib.md5(f"{key}|{nth}|9".encode()).hexdigest()[:8], 16) * (n_pool - len(mine)) >> 32
                    if len(mine) < n_pool:
                        for x in mine:
                            d += x <= d
                        mine = sorted([*mine, d])
                        want.append(d)
                assert line == want + [-1] * (5 - len(want))


def test_rendered_samples_are_shuffled_no_more(spark):
    """An item's text comes with its metadata, so that long texts of users meet no join; and the user's text is rendered once, though validity looks at it."""
    from recfeat.plans import features

    plan = features.model_samples(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython [") == 1


def test_described_items_make_samples(spark):
    """Items bring text, patch and flag; one without a name has no text, so its rows are no samples, though they stay in their user's past."""
    data = [("a", "C", "t é", 100.0, ["f"], ["d&amp;"]), (" ", "C", "t", None, None, None), ("b", None, "", None, [], None)]
    items = spark.createDataFrame(data, "parent_asin string, main_category string, product_title string, price double, features array<string>, description array<string>")
    patches = spark.createDataFrame([("a", b"2"), ("a", b"1"), (" ", b"3")], "parent_asin string, patch binary")
    made = assemble.described(items, patches)
    got = {r.parent_asin: (r.item_text, r.patch and bytes(r.patch), r.has_image) for r in made.collect()}
    assert got["a"] == ("Item category: C. Item title: t é. Item price: 100.00. Item features: f; Item description: d&;", b"1", 1) and got[" "] == (None, None, 0)
    assert got["b"][0].startswith("Item category: Unknown category. Item title: No title.") and got["b"][1:] == (None, 0)
    feat = F.struct(
        F.create_map().cast("map<string,double>").alias("cat_hist"), F.lit(0).cast("long").alias("review_cnt"), F.lit(None).cast("double").alias("price_mean"), F.lit(0.0).alias("price_std"),
        F.array(F.struct(F.lit("T").alias("title"), F.lit("x\ny").alias("text"))).alias("history"),
    )
    rows_ = made.select("*", F.lit("u").alias("user_id"), F.lit("r").alias("row_key"), feat.alias("user_feat"), F.lit(1).alias("label_good"), F.lit(0).alias("label_best"))
    got = {r.key: r for r in assemble.valid(assemble.samples(rows_)).collect()}
    assert set(got) == {"u-a-4b43b0", "u-b-4b43b0"} and got["u-a-4b43b0"].user_text.endswith("Review1: x y;") and bytes(got["u-a-4b43b0"].patch) == b"1"
    assert got["u-b-4b43b0"].has_image == 0 and got["u-b-4b43b0"].patch is None and len(got["u-a-4b43b0"]["shape"]) > 0
