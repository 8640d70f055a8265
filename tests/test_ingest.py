import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from recfeat.schemas import RAW_META, RAW_REVIEW
from recfeat.sources import images, ingest, shards, sinks

from .conftest import rows


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "raw string")


def test_bad_lines_are_set_aside(spark, tmp_path):
    (tmp_path / "a.json").write_text('not json\n\n   \n[1]\n{"asin":"x"}\n{"asin": 1\n')
    good, bad = ingest.parse_lines(ingest.read_lines(spark, str(tmp_path)), RAW_META)
    assert [r.asin for r in good.collect()] == ["x"]
    assert rows(bad) == [("malformed", '{"asin": 1'), ("not an object", "[1]"), ("not an object", "not json")]


def test_gzip_globs_and_missing_paths(spark, tmp_path):
    spark.range(3).select(F.to_json(F.struct("id")).alias("value")).write.option("compression", "gzip").text(str(tmp_path / "a"))
    assert ingest.read_lines(spark, [str(tmp_path / "a" / "*.gz")]).count() == 3
    with pytest.raises(AnalysisException):
        ingest.read_lines(spark, str(tmp_path / "none" / "*.gz")).count()


def test_item_key(spark):
    df = spark.createDataFrame([("", "B1"), (None, "B2"), (" ", ""), (None, None), ("P", "B3"), (" Q ", None)], "parent_asin string, asin string")
    assert sorted(r.parent_asin for r in ingest.with_key(df).collect()) == ["B1", "B2", "P", "Q"]


def test_price(spark):
    df = spark.createDataFrame([(v,) for v in ("", "None", "$12", "12.5", "nan", None, " 7 ", "1_0", "3d", '"9.5"')], "p string")
    assert [r[0] for r in df.select(ingest.price(F.col("p"))).collect()] == [None, None, None, 12.5, None, None, 7.0, None, None, 9.5]


def test_images_and_details(spark):
    layouts = [
        ({"hi_res": ["a", None], "large": ["b", "c"], "thumb": ["d", "e"], "variant": ["M"]}, 1, "a"),
        ([{"hi_res": None, "large": "", "thumb": "t"}], 1, "t"),
        ([], 0, ""),
        (None, 0, ""),
    ]
    df = spark.createDataFrame([(None if x is None else json.dumps(x),) for x, _, _ in layouts], "i string")
    got = df.select(ingest.images(F.col("i")).alias("images")).select(F.size("images"), ingest.main_image("images")).collect()
    assert [tuple(r) for r in got] == [(n, u) for _, n, u in layouts]
    df = spark.createDataFrame([('{"a":"1"}',), ('"{\\"b\\": \\"2\\"}"',), ('{"a":"x"}',), (None,), ("oops",)], "d string")
    assert [r[0] for r in df.select(ingest.details(F.col("d"))).collect()] == [{"a": "1"}, {"b": "2"}, {"a": "x"}, {}, {}]


def test_details_inside_landed_lines(spark):
    line = json.dumps({"parent_asin": "A", "details": json.dumps({"Size": "4"}), "features": None, "description": "one text"})
    other = json.dumps({"parent_asin": "B", "details": {"Size": "5"}, "description": ["x", "y"], "price": 3.5})
    good, bad = ingest.parse_lines(lines(spark, [line, other]), RAW_META)
    got = {r.parent_asin: r for r in ingest.clean_meta(good).collect()}
    assert bad.count() == 0 and got["A"].details == {"Size": "4"} and got["B"].details == {"Size": "5"}
    assert got["A"].description == ["one text"] and got["B"].description == ["x", "y"] and got["B"].price == 3.5 and got["A"].features is None


def test_reviews_have_defaults(spark):
    good, _ = ingest.parse_lines(lines(spark, ['{"user_id":"u","asin":"a","rating":4.0,"timestamp":5}']), RAW_REVIEW)
    r = ingest.clean_reviews(good).first()
    assert (r.parent_asin, r.title, r.text, r.sort_timestamp, r.verified_purchase, r.helpful_votes) == ("a", "", "", 5, False, 0)


def test_json_sinks(spark, tmp_path):
    df = spark.range(25).select("id", F.lit(None).cast("string").alias("none"), F.lit("é").alias("t")).coalesce(1)
    sinks.write_json_rows(df, str(tmp_path / "a"), 10)
    assert len(list((tmp_path / "a").glob("*.gz"))) == 3
    assert spark.read.text(str(tmp_path / "a")).where("value like '%\"none\":null,\"t\":\"é\"%'").count() == 25
    sinks.write_json_files(df, str(tmp_path / "b"), 4)
    assert len(list((tmp_path / "b").glob("*.gz"))) == 4
    split = df.select("id", F.when(F.col("id") > 5, "c").alias("main_category"), F.lit("train").alias("split"))
    sinks.write_by_split(split, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).groupBy("main_category").count().orderBy("main_category").collect() == [("UNK", 6), ("c", 19)]


def test_variants_give_what_text_gives(spark):
    data = [
        '{"parent_asin":"A","images":[{"hi_res":null,"large":"u"},{"thumb":"t"}],"price":"$5","details":"{\\"Size\\": \\"4\\"}","description":["x","y"],"features":["f"],"title":"t é"}',
        '{"parent_asin":"B","images":{"hi_res":["a","b"],"large":["c"],"variant":["MAIN","PT"],"thumb":["d","e"]},"price":3.5,"details":{"k":"v"},"description":"one","rating_number":7,"average_rating":4.5}',
        '{"asin":"C","price":"12.25","images":null,"details":null,"description":null,"bought_together":null,"categories":["p","q"]}', '{"parent_asin":"D","images":"none","details":"x","price":"nan"}', "{}",
        '{"parent_asin":"E","images":{},"details":[],"price":true}', "[1]", '{"a":', "7",
    ]
    text, bad = ingest.parse_lines(lines(spark, data), RAW_META)
    variants, rejects = ingest.parse_variants(lines(spark, data))
    table = ingest.shredded(variants, "variants")
    made = ingest.clean_variants(table)
    order = lambda df: sorted((r.asDict(True) for r in df.collect()), key=repr)
    assert order(made) == order(ingest.clean_meta(text)) and rows(rejects) == rows(bad)
    plan = made.select("title")._jdf.queryExecution().executedPlan().toString()
    assert "struct<v:struct<0:string>>" in plan  # only the field is read


def test_counts_of_a_pass_equal_the_rejects(spark):
    from pyspark.sql import Observation

    spark = spark.newSession()
    data = ['{"user_id":"u"}', '{"user_id":', "[1]", "7", '{"user_id":5}', "{}", '"x"']
    good, bad = ingest.parse_lines(lines(spark, data), RAW_REVIEW)
    seen = Observation("seen")
    counted = ingest.parse_counted(lines(spark, data), RAW_REVIEW, seen)
    assert rows(counted) == rows(good)
    reasons = {r.reason: r["count"] for r in bad.groupBy("reason").count().collect()}
    assert seen.get == {"lines": 7, "rows": good.count(), "malformed": reasons["malformed"], "not_object": reasons["not an object"]}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
    none = Observation("none")
    ingest.parse_counted(lines(spark, data).limit(0), RAW_REVIEW, none).collect()
    assert set(none.get.values()) == {0}


def test_a_second_run_replaces_its_split_alone(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(i, s, c) for i in range(6) for s in ("train", "test") for c in ("a", None)], "id int, split string, main_category string")
    sinks.write_by_split(df, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").glob("split=train/*/*.json")}
    sinks.write_by_split(df.where("split = 'test' and id < 2"), path, again=True)
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "s").glob("split=train/*/*.json")} and len(before) >= 2
    back = sinks.read_split(spark, path, "id int", "test")
    assert rows(back) == sorted(((i, "test", c) for i in range(2) for c in ("a", "UNK")), key=repr)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and sinks.read_split(spark, path, "id int", "train").count() == 12


def test_shards_round_trip(spark, tmp_path):
    shards.register(spark)
    data = [(f"k{i}", f"user é {i}", "item", bytes([i % 256] * 4) if i % 3 else None, [4], int(i % 3 > 0), i % 2, 0) for i in range(50)]
    df = spark.createDataFrame(data, shards.SCHEMA).repartition(3)
    for _ in range(2):
        df.write.format("tar_shards").option("path", str(tmp_path / "s")).option("rows_per_shard", 10).mode("overwrite").save()
    back = spark.read.format("tar_shards").option("path", str(tmp_path / "s")).load()
    assert rows(back.select(*df.columns)) == rows(df)
    assert not list((tmp_path / "s").glob("*.pending"))
    with pytest.raises(Exception, match="no shard matches"):
        spark.read.format("tar_shards").option("path", str(tmp_path / "none")).load().count()


def test_shards_keep_equal_and_odd_keys_apart(spark, tmp_path):
    """Two samples of one key that lie side by side stay two; dots, slashes and percent signs in keys come back."""
    shards.register(spark)
    data = [(k, f"u{i}", "item", None, [1], 0, 0, 0) for i, k in enumerate(["a", "a", "a.b", "a", "a/b.json", "50%2E", "é x", "é x"])]
    for path in (str(tmp_path / "s"), f"file://{tmp_path}/t"):
        spark.createDataFrame(data, shards.SCHEMA).coalesce(1).write.format("tar_shards").option("path", path).mode("append").save()
        for where in (path, f"{path}/samples-*.tar.gz"):
            back = spark.read.format("tar_shards").option("path", where).load()
            assert sorted((r.key, r.user_text) for r in back.collect()) == sorted((k, t) for k, t, *_ in data)
    with pytest.raises(Exception, match="nosuch"):
        spark.read.format("tar_shards").option("path", "nosuch://x/y").load().count()


def test_a_condition_on_keys_reads_their_samples_alone(spark, tmp_path, monkeypatch):
    """One in a hundred keys: about one in a hundred of the bytes, and the index."""
    import os

    from pyarrow import fs
    from pyspark.sql.datasource import In

    shards.register(spark)
    path = str(tmp_path / "s")
    data = [(f"k{i % 395}", f"user {i}", "item", os.urandom(4000), [4000], 1, i % 2, 0) for i in range(400)]
    df = spark.createDataFrame(data, shards.SCHEMA).repartition(2)
    df.write.format("tar_shards").option("path", path).option("rows_per_shard", 150).mode("append").save()
    read = spark.read.format("tar_shards").option("path", path).load()
    wanted = ["k3", "k17", "k111", "absent"]
    assert rows(read.where(F.col("key").isin(wanted)).select(*df.columns)) == rows(df.where(F.col("key").isin(wanted)))
    assert rows(read.where("key = 'k3' and label_good = 1").select(*df.columns)) == rows(df.where("key = 'k3' and label_good = 1"))
    assert read.where("key = 'k3' and key = 'k17'").count() == 0

    count = {"bytes": 0}
    kept = fs.LocalFileSystem()

    class Counting:
        def __getattr__(self, name):
            return getattr(kept, name)

        def open_input_stream(self, where, compression=None):
            count["bytes"] += os.path.getsize(where)
            return kept.open_input_stream(where, compression=compression)

        def open_input_file(self, where):
            raw = kept.open_input_file(where)
            if where.endswith(".idx"):
                return raw

            class Places:
                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    raw.close()

                def read_at(self, size, start):
                    count["bytes"] += size
                    return raw.read_at(size, start)

            return Places()

    monkeypatch.setattr(shards, "located", lambda p: (Counting(), p))
    total = sum(p.stat().st_size for p in (tmp_path / "s").glob("*.tar.gz"))
    for keys, most in ((["k100", "k200", "k300", "k390"], 0.012), (None, 1.0)):
        reader, count["bytes"] = shards._Reader(path), 0
        if keys:
            list(reader.pushFilters([In(("key",), tuple(keys))]))
        got = [r for p in reader.partitions() for r in reader.read(p)]
        assert len(got) == (4 if keys else 400) and count["bytes"] <= most * total
    assert sum(p.stat().st_size for p in (tmp_path / "s").glob("*.idx")) < 0.02 * total
    for p in (tmp_path / "s").glob("*.idx"):  # shards of others have none
        p.unlink()
    monkeypatch.undo()
    assert read.where("key = 'k3'").count() == df.where("key = 'k3'").count()


def test_many_small_shards_are_few_partitions_and_any_tar_is_read(spark, tmp_path):
    """Neighbouring shards share a partition; shards are what tarfile makes, and those of others, plain or with long names, give the same samples."""
    import gzip
    import io
    import tarfile

    for name, size in (("a.user.json", 5), ("x" * 89 + ".label.json", 0), ("k" * 100, 8**11 - 1), ("k" * 101, 7), ("k", 8**11)):
        info = tarfile.TarInfo(name)
        info.size = size
        assert shards._header(name, size) == info.tobuf(tarfile.PAX_FORMAT)
    data = [(f"k{i}" + "x" * (120 if i == 205 else 0), f"user é {i}", "item", bytes([i % 256] * 4) if i % 3 else None, [4], int(i % 3 > 0), i % 2, 0) for i in range(300)]
    shards.register(spark)
    df, path = spark.createDataFrame(data, shards.SCHEMA).coalesce(2), tmp_path / "s"
    df.write.format("tar_shards").option("path", str(path)).option("rows_per_shard", 1).mode("append").save()
    parts = shards._Reader(str(path)).partitions()
    assert len(list(path.glob("*.gz"))) == 300 and len(parts) == shards.PARTITIONS
    assert sorted(p for x in parts for p in x.paths) == sorted(map(str, path.glob("*.gz")))
    read = lambda where: rows(spark.read.format("tar_shards").option("path", str(where)).load().select(*df.columns))
    assert read(path) == rows(df)
    (tmp_path / "o").mkdir()
    for compression, some in (("", slice(100)), ("gz", slice(100, 200)), ("bz2", slice(200, 300))):
        with tarfile.open(tmp_path / "o" / f"other.tar{compression and '.' + compression}", f"w:{compression}") as tar:
            for nth, sample in enumerate(data[some]):
                for kind, content in shards._members(dict(zip(df.columns, sample))):
                    info = tarfile.TarInfo(f"{sample[0]}.{kind}")
                    info.size, info.mtime = len(content), 0 if nth < 50 else 5
                    tar.addfile(info, io.BytesIO(content))
    assert read(tmp_path / "o") == rows(df)
    assert len(shards._dealt([("a", 0), ("b", 0)])) == 2 and len(shards._dealt([(str(i), (1 << 20) - 1) for i in range(32 * 100)])) == 100
    whole = next(path.glob("*.gz"))
    with tarfile.open(whole) as tar, gzip.open(whole) as plain:
        assert [(m.name, tar.extractfile(m).read()) for m in tar] == list(shards._plain_members(plain))


def test_shards_as_a_stream_sink_write_each_sample_once(spark, tmp_path):
    shards.register(spark)
    source, path, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    make = lambda k: [(f"k{k}-{i}", "u", "i", None, [2], 0, i % 2, 0) for i in range(20)]
    write = lambda k: spark.createDataFrame(make(k), shards.SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(shards.SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.writeStream.format("tar_shards").option("path", path).option("rows_per_shard", 8).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()

    keys = lambda: sorted(r.key for r in spark.read.format("tar_shards").option("path", path).load().collect())
    write(0)
    write(1)
    run()
    assert keys() == sorted(f"k{k}-{i}" for k in (0, 1) for i in range(20))
    for name in ("commits/1", "commits/.1.crc"):  # as if the driver had gone after the sink's commit, before the stream's
        (tmp_path / "state" / name).unlink()
    write(2)
    run()
    assert keys() == sorted(f"k{k}-{i}" for k in range(3) for i in range(20))
    (tmp_path / "state/commits/2").unlink()
    (tmp_path / "out/_committed-2").unlink()  # gone in the middle of the sink's commit
    (tmp_path / "state/commits/.2.crc").unlink()
    run()
    assert keys() == sorted(f"k{k}-{i}" for k in range(3) for i in range(20)) and not list((tmp_path / "out").glob("*.pending"))


def test_tables_of_an_application_can_be_removed(spark):
    import os

    from recfeat import tables

    tables.as_table(spark.range(3), "x").count()
    folder = tables.own_folder(spark).removeprefix("file:")
    assert os.path.isdir(folder)
    tables.remove_tables(spark)
    assert not os.path.exists(folder)


def test_fetch_drops_failures(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"img")
    df = spark.createDataFrame([("a", f"file://{tmp_path}/x"), ("b", f"file://{tmp_path}/y"), ("c", "")], "parent_asin string, url string")
    got = images.fetch(df).collect()
    assert [(r.parent_asin, bytes(r.content)) for r in got] == [("a", b"img")]


def png(pixels):
    import struct
    import zlib

    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = zlib.compress(b"".join(b"\0" + row.tobytes() for row in pixels))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def test_landed_images_become_patch_lines_and_come_back(spark, tmp_path):
    import numpy as np

    from recfeat.functions import image
    from recfeat.sources import patches

    folder = tmp_path / "img"
    folder.mkdir()
    pixels = np.random.default_rng(0).integers(0, 256, (256, 256, 3)).astype(np.uint8)
    (folder / "B01.x.png").write_bytes(png(pixels))
    (folder / "bad.png").write_bytes(b"nothing")
    made = patches.landed_patches(spark, str(folder))
    sinks.write_json_files(patches.to_lines(made), str(tmp_path / "out"), 2)
    back, bad = patches.read_patches(spark, str(tmp_path / "out" / "*.gz"))
    got = back.collect()
    assert bad.count() == 0 and [(r.parent_asin, r["shape"]) for r in got] == [("B01.x", image.SHAPE)]
    want = image.to_patches(image.centre_crop(pixels.transpose(2, 0, 1)))
    assert bytes(got[0].patch) == want.tobytes()
    odd = lines(spark, ['{"parent_asin":" ","patch_b64":"AA=="}', '{"parent_asin":"a","patch_b64":"*"}', "x"])
    rows_back, bad = patches.from_lines(odd)
    assert (rows_back.count(), bad.count()) == (0, 1)


def test_small_samples_share_their_compression(spark, tmp_path):
    """Samples of a few hundred bytes take less than half of what each takes alone; keys still bring their samples, and no others of their runs."""
    import hashlib
    import tarfile

    from pyspark.sql.datasource import In

    shards.register(spark)
    path = tmp_path / "s"
    data = [(f"{i * 7 % 900}-{i}-{hashlib.md5(b'%d' % (i % 1990)).hexdigest()[:6]}", "2-HIGH F" if i % 3 else None, 'cold "gizmo" é\n', hashlib.md5(b"%d" % i).hexdigest().encode(), [32], 1, i % 2, 0) for i in range(2000)]
    df = spark.createDataFrame(data + [data[5], ("big", "u" * 9000, "i", bytes(range(256)) * 50, [12800], 1, 1, None)], shards.SCHEMA).coalesce(1)
    df.write.format("tar_shards").option("path", str(path)).mode("append").save()
    assert rows(spark.read.format("tar_shards").option("path", str(path)).load().select(*df.columns)) == rows(df)
    assert sum(p.stat().st_size for p in path.glob("*.gz")) < 2000 * 160 and sum(p.stat().st_size for p in path.glob("*.idx")) < 2000 * 25
    reader, wanted = shards._Reader(str(path)), {data[5][0], data[6][0], data[1500][0], "big", "absent"}
    list(reader.pushFilters([In(("key",), tuple(wanted))]))
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(r[0] for r in got) == sorted([data[5][0]] * 2 + [data[6][0], data[1500][0], "big"])
    assert max(len(r[1]) for r in got if r[1]) == 9000
    members = {}
    for p in path.glob("*.gz"):
        with tarfile.open(p) as tar:
            members |= {m.name: tar.extractfile(m).read() for m in tar}
    assert len(members) == 2001 * 5 and members[f"{data[0][0]}.user.json"] == b'{"text": null}'
    assert members[f"{data[0][0]}.item.json"] == '{"text": "cold \\"gizmo\\" é\\n"}'.encode() and members["big.label.json"] == b'{"good": 1, "best": null}'


def test_shuffle_files_go_with_the_table_they_made(spark):
    """A table's step leaves no shuffle file, has parts by its rows, and the settings come back."""
    from pathlib import Path

    from recfeat import tables

    files = lambda: set(Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))
    before, parts = files(), spark.conf.get("spark.sql.shuffle.partitions")
    with tables.lean(spark, 45, rows_per_part=5):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
        made = tables.as_table(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "lean")
    assert not files() - before and spark.conf.get("spark.sql.shuffle.partitions") == parts and spark.conf.get(tables.CLEANUP, None) is None
    with tables.lean(spark, 1):
        assert spark.conf.get("spark.sql.shuffle.partitions") == parts
    assert made.count() == 7
