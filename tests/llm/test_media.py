import numpy as np
import pyarrow as pa
import pytest

from recfeat.llm import media
from recfeat.llm.common import table

from ..conftest import SMALL, rows


def vectors(spark, n=60):
    return table(spark, SMALL, "embeddings").where(f"vec_id < {n}")


def test_edited_copies_are_found(spark):
    images = media.vector_images(vectors(spark, 200))
    got = media.find_copies(media.edited_images(images), images).toPandas()
    found = [any(m["class_id"] == r.image_id for m in r.matches) for r in got.itertuples()]
    assert len(got) == 200 and np.mean(found) >= 0.9  # recall
    assert np.mean([m["class_id"] != r.image_id for r in got.itertuples() for m in r.matches] or [0]) < 0.05  # few are wrong


def brute(queries, gallery, min_votes, max_distance):
    """Every corner of one side against every corner of the other, votes in a plain table."""
    votes = {}
    for q in queries:
        for g in gallery:
            if sum(bin(a ^ b).count("1") for a, b in zip(q.segments, g.segments)) > max_distance:
                continue
            turn = round((q.angle - g.angle) * 12 / (2 * np.pi)) % 12
            step = round(np.log2(q.scale / g.scale))
            y, x = g.y * 2.0**step, g.x * 2.0**step
            sin, cos = np.sin(turn * np.pi / 6), np.cos(turn * np.pi / 6)
            dy, dx = round((q.y - (sin * x + cos * y)) / media.SHIFT_BIN), round((q.x - (cos * x - sin * y)) / media.SHIFT_BIN)
            for a in (0, 1):
                for b in (0, 1):
                    votes.setdefault((q.image, g.image), {}).setdefault((turn, step, dy + a, dx + b), set()).add(q.point)
    best = {k: max(map(len, v.values())) for k, v in votes.items()}
    return sorted((q, g, n) for (q, g), n in best.items() if n >= min_votes)


@pytest.mark.parametrize("distance", [3, 6, media.MAX_DISTANCE])
def test_tables_and_votes_find_what_brute_force_finds(spark, distance):
    """Up to the guaranteed distance no pair of corners is missed, and the votes are those of a plain count."""
    images = media.vector_images(vectors(spark, 24))
    points, copies = media.descriptors(images), media.descriptors(media.edited_images(images))
    for least in (1, 3):
        got = media.matches(copies, points, min_votes=least, max_distance=distance).collect()
        assert sorted(map(tuple, got)) == brute(copies.collect(), points.collect(), least, distance)


def test_equal_images_are_one_class(spark):
    v = vectors(spark, 5)
    copies = v.selectExpr("vec_id + 100 vec_id", "embedding").unionByName(v.select("vec_id", "embedding"))
    images = media.vector_images(copies)
    assert rows(media.content_classes(images)) == sorted([(i, i % 100) for k in range(5) for i in (k, k + 100)], key=repr)
    got = media.find_copies(images, images).collect()
    assert len(got) == 10 and all([m.class_id for m in r.matches] == [r.class_id] for r in got)


def test_bad_images(spark):
    df = spark.createDataFrame([(1, None, 0, 0), (2, b"xx", 3, 3), (3, bytes(9), 3, 3), (3, bytes(9), 3, 3), (None, bytes(2500), 50, 50)], "image_id long, pixels binary, height int, width int")
    assert media.descriptors(df).count() == 0 and media.find_copies(df, df).where("n_matches > 0").count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [1.0]), (4, [float("nan")] * 4), (5, [1.0] * 5)], "vec_id long, embedding array<double>")
    assert [(r.image_id, r.height) for r in media.vector_images(odd).orderBy("image_id").collect()] == [(1, 0), (2, 0), (3, 0), (4, 12), (5, 12)]
    assert media.edited_images(media.vector_images(odd)).count() == 5
    assert media.find_copies(df.limit(0), df).count() == 0


def test_descriptors_turn_with_the_image():
    rng = np.random.default_rng(0)
    image = np.kron(rng.integers(0, 255, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    a, b = media.describe(image), media.describe(np.ascontiguousarray(np.rot90(image)))
    near = [min(np.bitwise_count((x[4] ^ y[4]).astype(np.uint32)).sum() for y in b) for x in a]
    assert np.mean(np.array(near) <= media.MAX_DISTANCE) > 0.7


def changed(images, change):
    """``images`` with their pixels (a float array) changed."""

    def run(batches):
        for batch in batches:
            out = []
            for key, pixels, h, w in zip(*(c.to_pylist() for c in batch.columns)):
                new = np.clip(np.rint(change(np.frombuffer(pixels, np.uint8).reshape(h, w).astype(float), key)), 0, 255).astype(np.uint8)
                out.append((key, new.tobytes(), *new.shape))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), batch.schema.types)], schema=batch.schema)

    return images.mapInArrow(run, images.schema)


def noisy(image, key):
    return image + np.random.default_rng(key).normal(0, 6, image.shape)


def blurred(image, key):
    return media._box(np.pad(image, 1, mode="edge"), 1)[1:-1, 1:-1] / 9


@pytest.mark.parametrize("change", [noisy, blurred])
def test_noisy_and_blurred_copies_are_found(spark, change):
    images = media.vector_images(vectors(spark, 100)).cache()
    got = media.find_copies(changed(images, change), images).collect()
    found = np.mean([any(m["class_id"] == r.image_id for m in r.matches) for r in got])
    print(change.__name__, len(got), found, np.mean([m["class_id"] != r.image_id for r in got for m in r.matches]))
    assert found >= 0.9
    assert np.mean([m["class_id"] != r.image_id for r in got for m in r.matches]) < 0.02


def test_both_scales_of_the_registered_images_have_corners(spark):
    assert {r.scale for r in media.descriptors(media.vector_images(vectors(spark, 20))).select("scale").distinct().collect()} == set(media.SCALES)


def test_blocks_of_queries_do_not_change_the_matches(spark):
    points = media.descriptors(media.vector_images(vectors(spark, 20)))
    assert rows(media.matches(points, points, block_points=100)) == rows(media.matches(points, points))


def large(spark, n=6, side=160):
    """Images of smooth random texture."""
    out = []
    for k in range(n):
        image = np.random.default_rng(100 + k).normal(0, 1, (side, side))
        for _ in range(2):
            image = media._box(image, 2)
        image = (image - image.min()) / (image.max() - image.min()) * 255
        out.append((k, np.rint(image).astype(np.uint8).tobytes(), side, side))
    return spark.createDataFrame(out, "image_id long, pixels binary, height int, width int")


def halved(image, key):
    return image.reshape(image.shape[0] // 2, 2, image.shape[1] // 2, 2).mean(axis=(1, 3))


def corner_crop(image, key):
    return image[:56, :56]


def found_own(spark, images, queries):
    got = media.find_copies(queries, images).collect()
    return [[m.class_id for m in r.matches] == [r.image_id] for r in got]


def test_copies_at_half_and_twice_the_size_are_found(spark):
    images = large(spark).cache()
    small = changed(images, halved).cache()
    assert found_own(spark, images, small) == [True] * 6 and found_own(spark, small, images) == [True] * 6


def test_a_crop_without_the_strongest_corners_is_found(spark):
    """In the crop the contrast is low, so that the strongest corners of the image lie elsewhere."""
    faint = changed(large(spark), lambda im, k: np.where(np.maximum(*np.indices(im.shape)) < 64, 128 + (im - 128) / 4, im)).cache()
    assert found_own(spark, faint, changed(faint, corner_crop)) == [True] * 6
