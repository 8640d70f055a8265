import numpy as np
import pytest
from pyspark.sql import functions as F

from recfeat.functions import chunks, image, text, vectors
from recfeat.operators import evaluate


def one(spark, column, value=0, kind="int"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


def test_cleaning(spark):
    dirty = "“Tom &amp; Jerry”…\n—\\x"
    assert one(spark, text.clean(F.col("v")), dirty, "string") == '"Tom & Jerry"... - x'
    assert one(spark, text.clean(F.col("v")), "ｆｕｌｌ 😀‍\x07 b", "string") == "full grinning_face b"
    assert one(spark, text.clean(F.col("v")), None, "string") is None
    assert one(spark, text.clean_native(F.col("v")), 'a\\"b\\\'c\\d  e', "string") == "a\"b'c d e"


def test_emoji_units_and_sequences():
    """Only what has the emoji property is named, whole sequences at once; units and marks are left to NFKC."""
    clean = lambda t: " ".join(text._normal(t).split())
    assert clean("5㎏ bag, ㈱ABC, 30㎝, Ⓐ, ⠿") == "5kg bag, (株)ABC, 30cm, A, ⠿"
    assert clean("ok👍🏽!") == "ok thumbs_up_sign_medium_skin_tone !" and clean("👍") == "thumbs_up_sign"
    assert clean("🇫🇷🇩🇪") == "flag_fr flag_de" and clean("3️⃣") == "keycap_3" and clean("7 #1 *") == "7 #1 *"
    assert clean("👩‍💻 ❤️ ©") == "woman_personal_computer heavy_black_heart copyright_sign"
    assert clean("\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f") == "flag_gbeng" and clean("❝x❞") == "❝x❞"


def test_smart_join(spark):
    assert one(spark, text.smart_join(F.col("v")), [" a ", "b.", "c！", "1"], "array<string>") == "a; b. c！ 1;"
    assert one(spark, text.smart_join(text.clean_array(F.col("v"))), ["abc."], "array<string>") == "abc."
    assert one(spark, text.clean_array(F.col("v")), None, "array<string>") == []


def test_rendered_texts(spark):
    kind = "struct<cat_hist:map<string,double>,review_cnt:bigint,price_mean:double,price_std:double,history:array<struct<title:string,text:string>>>"
    new = ({}, 0, None, 0.0, [])
    assert one(spark, text.user_text(F.col("v")), new, kind) == (
        "Category history: No browsing history. Total reviews: No reviews. Avg price: N/A. Price std: No price variation. Review history: No review history."
    )
    old = ({"a": 0.125, "b": 0.0, "c": 0.875}, 3, 0.125, 1.5, [("t", ""), ("", "x y."), ("", None)])
    assert one(spark, text.user_text(F.col("v")), old, kind) == (
        "Category history: a: 12%; c: 88%. Total reviews: 3. Avg price: 0.12. Price std: 1.50. Review history: Review1: t; Review2: x y."
    )
    nothing = text.item_text(F.lit(None), F.lit(""), F.lit(None).cast("double"), F.col("v"), F.array().cast("array<string>"))
    assert one(spark, nothing, None, "array<string>") == (
        "Item category: Unknown category. Item title: No title. Item price: N/A. Item features: No features. Item description: No description."
    )


def test_sentences_and_chunks(spark):
    assert one(spark, text.sentences(F.col("v")), "A b. C!  D？E\nF", "string") == ["A b.", "C!", "D？", "E", "F"]
    assert one(spark, text.sentences(F.col("v")), None, "string") == []
    seven = [" ".join(["w"] * 100)] * 7
    words = chunks.words_as_ids(F.col("v"))
    got = one(spark, chunks.sentence_chunks(words), seven, "array<string>")
    assert [(len(c.ids), c.marks) for c in got] == [(305, [1, 102, 203]), (305, [1, 102, 203]), (103, [1])]
    long = one(spark, chunks.sentence_chunks(words, max_tok=10, max_chunks=2), [" ".join(["w"] * 100)] * 3, "array<string>")
    assert [len(c.ids) for c in long] == [10, 10]
    assert one(spark, chunks.padded(F.col("v"), 4, -1), [1, 2], "array<int>") == [1, 2, -1, -1]
    assert one(spark, chunks.padded(F.col("v"), 1, -1), [1, 2], "array<int>") == [1]
    assert one(spark, chunks.within_vocabulary(F.col("v"), 10), [9, 10], "array<int>") == [9, 0]


def test_patches_round_trip(spark):
    pixels = np.random.default_rng(0).integers(0, 256, 3 * 224 * 224).astype(np.uint8)
    df = spark.createDataFrame([(pixels.tobytes(),), (b"short",), (None,)], "v binary").select(image.patchify("v").alias("p"))
    got = df.select("p", image.unpatchify("p").alias("back"), image.pixel_values("p").alias("x")).collect()
    assert bytes(got[0].back) == pixels.tobytes() and got[1].p is None and got[2].back is None
    x = np.array(got[0].x).reshape(3, 224, 224) * np.array(image.STD)[:, None, None] + np.array(image.MEAN)[:, None, None]
    assert np.abs(x * 255 - pixels.reshape(3, 224, 224)).max() < 1e-2 and not any(got[1].x)
    assert np.array_equal(image.to_patches(pixels.reshape(3, 224, 224))[1, :16], pixels.reshape(3, 224, 224)[0, 0, 16:32])


def test_image_rows(spark):
    raw = bytes(range(256)) * 3 * 300
    ok = spark.createDataFrame([(raw[: 3 * 280 * 240], 280, 240), (b"x", 2, 2)], "d binary, h int, w int").select(image.image_patches("d", "h", "w").alias("p")).collect()
    assert len(ok[0].p) == 3 * 224 * 224 and ok[1].p is None
    flat = np.full((3, 300, 260), 7, dtype=np.uint8)
    assert image.resize(flat, 256).shape == (3, 295, 256) and (image.centre_crop(image.resize(flat, 256)) == 7).all()


def test_vectors(spark):
    v = F.col("v")
    assert one(spark, vectors.cosine(v, F.array(F.lit(2.0), F.lit(0.0))), [3.0, 4.0], "array<double>") == pytest.approx(0.6)
    assert one(spark, vectors.norm(vectors.normalised(v)), [0.0, 0.0], "array<double>") == 0
    assert [one(spark, vectors.finite(v), x, "array<double>") for x in ([1.0], [float("nan")], [float("inf")], [None])] == [True, False, False, False]
    assert [one(spark, vectors.safe_float(v), x, "string") for x in ("2", "NaN", "inf", "x", None)] == [2, 0, 0, 0, 0]
    assert sum(one(spark, vectors.softmax(v), [1.0, 2.0, 900.0], "array<double>")) == pytest.approx(1)
    experts = [[1.0, 2.0], [3.0, 4.0]]
    w = one(spark, vectors.gate(v, [[1.0, 0.0], [0.0, 1.0]]), experts, "array<array<double>>")
    e = np.exp([2.0, 3.0])
    assert w == pytest.approx(list(e / e.sum()))
    assert one(spark, vectors.fuse(v, F.array(F.lit(0.25), F.lit(0.75))), experts, "array<array<double>>") == [2.5, 3.5]


def test_auc(spark):
    tied = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "s double, y int")
    assert evaluate.auc(tied, "s", "y").first() == (0.75, 3, 2)
    assert evaluate.auc(tied.where("y = 1"), "s", "y").first().auc is None and evaluate.auc(tied.limit(0), "s", "y").first().auc is None
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 60, 700) / 7, rng.integers(0, 2, 700)
    pairs = (s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    assert evaluate.auc(df, "s", "y").first().auc == pytest.approx(pairs)
    points = sorted((r.fpr, r.tpr) for r in evaluate.roc_points(df, "s", "y").collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip([(0, 0), *points], points))
    assert area == pytest.approx(pairs)


def test_running_sums_equal_one_window(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).cast("double").alias("k"), F.lit(1).alias("n"))
    assert evaluate.running(df, "k", ["n"], rows_per_bucket=150).where("n_before <> k").count() == 0


def test_weighted_metrics(spark):
    df = spark.createDataFrame([(1, 2.0, 3), (1, 4.0, 1), (2, None, 5), (3, 1.0, 0)], "e int, m double, n int")
    assert [tuple(r) for r in evaluate.metric_rollup(df, "e", "m", "n").orderBy("e").collect()] == [(1, 4, 2.5), (3, 0, None)]
    balance = {r.task: tuple(r)[1:] for r in evaluate.class_balance(spark.createDataFrame([(1, 0), (0, 0), (1, None)], "a int, b int"), ["a", "b"]).collect()}
    assert balance == {"a": (1, 2, 0.5), "b": (2, 0, None)}


def test_network_scores(spark):
    def make():
        return lambda x: np.stack([x, -x], axis=1)

    df = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    got = [(r.prob_good, r.prob_best) for r in evaluate.score_batches(df, make, ["x"]).collect()]
    assert got[0] == (0.5, 0.5) and got[1][0] == pytest.approx(1 / (1 + np.exp(-2))) and sum(got[1]) == pytest.approx(1)


def test_first_batches(spark):
    assert [r.id for r in evaluate.first_batches(spark.range(100).orderBy(F.desc("id")), "id", 2, 3).orderBy("id").collect()] == list(range(6))
    assert evaluate.first_batches(spark.range(4), "id", 2, 3).count() == 4


def test_array_inputs_are_scored(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],)], "x array<double>")
    got = evaluate.score_batches(df, lambda: lambda x: x, ["x"], shapes=[[2]]).collect()
    assert got[0].prob_best == pytest.approx(1 / (1 + np.exp(-2))) and got[1].prob_good == 0.5


def test_images_are_made_a_few_at_a_time(spark, monkeypatch):
    """A batch of rows comes out in parts, so what a worker holds does not follow it; values used where they are made equal those handed on."""
    import pyarrow as pa
    from pyspark.sql import types as T

    monkeypatch.setattr(image, "AT_ONCE", 4)
    parts = list(image.patchify.func(iter([pa.array([bytes(3 * 224 * 224)] * 9 + [None], pa.binary())])))
    assert [len(p) for p in parts] == [4, 4, 2] and parts[2][1].as_py() is None
    df = spark.range(10).select("id", F.when(F.col("id") > 0, F.rpad(F.unhex(F.sha2(F.col("id").cast("string"), 256)), F.lit(3 * 224 * 224), F.lit(b"x"))).alias("p"))
    total = image.over_pixel_values(F.col("p"), lambda x: float(x[:5000].astype(float).sum()), T.DoubleType(), pa.float64())
    for r in df.select("id", total.alias("t"), F.slice(image.pixel_values("p"), 1, 5000).alias("x")).collect():
        assert r.t == pytest.approx(sum(r.x))


def test_ids_that_fit_no_chunk_are_not_made(spark):
    """Chunks are the same from the first words alone; texts whose sentences or number of them pass all bounds, none, and null."""
    import pyarrow as pa

    from recfeat.functions import chunks, pieces

    assert pieces._first_words(pa.array(["a b c", None, "d", "e"]), 2, 4) == [["a", "b"], [], ["d"]]
    data = [(1, ["one two three"] * 9), (2, ["w " * 50, "x", "y"]), (3, []), (4, None), (5, ["a", None, "zz top"]), (6, ["q"] * 40), (7, ["one two", "u " * 11, "three"])]
    df = spark.createDataFrame(data, "id long, s array<string>")
    vocabulary = {p.piece: p.id for p in pieces.learn(spark.createDataFrame([("one", 3), ("two", 2), (None, 1)], "word string, n long")).collect()}
    whole, short = (df.select("id", chunks.sentence_chunks(pieces.encoded(F.col("s"), vocabulary, **bound), max_tok=12, max_chunks=2).alias("c")) for bound in ({}, {"each": 9, "most": 20}))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, short.collect()))
