from pyspark.sql import functions as F

from recfeat.streaming import profile as streams

from .conftest import SMALL


def write(spark, folder, data):
    spark.createDataFrame(data, "user_id string, event_id long, ts timestamp, category string, price double").coalesce(1).write.mode("append").parquet(folder)


def test_profile_goes_on_over_batches_and_flags_late_rows(spark, tmp_path):
    import datetime as dt
    import time

    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    folder = str(tmp_path / "in")
    write(spark, folder, [("u", 2, t(2), "b", None), ("u", 1, t(1), "a", 10.0), ("v", 3, t(3), None, 5.0)])
    time.sleep(1.1)
    write(spark, folder, [("u", 4, t(4), "a", 20.0), ("u", 0, t(0), "a", 1.0)])
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {r.event_id: r for r in streams.drained(streams.running_profiles(stream), str(tmp_path)).collect()}
    assert (got[1].review_cnt, got[1].price_mean, got[1].price_std, got[1].cat_hist, got[1].history) == (0, None, 0.0, "", "")
    assert (got[2].review_cnt, got[2].price_mean, got[2].cat_hist, got[3].review_cnt) == (1, 10.0, "a:1", 0)
    assert got[0].late and got[0].review_cnt == 2  # too late to change what was given out
    assert (got[4].review_cnt, got[4].cat_hist, got[4].late) == (3, "a:2;b:1", False)


def test_window_counts_close(spark):
    rows = streams.read_table(spark, SMALL, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    total = streams.drained(streams.window_counts(rows)).agg(F.sum("n")).first()[0]
    assert 0 < total < spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_shuffled_events_equal_the_batch_in_order(spark, tmp_path):
    """Events in any order within the delay give what they give in order; later ones are dropped."""
    import datetime as dt
    import random
    import time

    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    data = [(f"u{rng.randrange(3)}", i, start + dt.timedelta(seconds=i // 3 * 7, milliseconds=rng.randrange(900)), rng.choice(["a", "b", None]), rng.choice([None, 1.5, 20.0])) for i in range(240)]
    moved = sorted(data, key=lambda r: r[1] + rng.randrange(40))  # at most 40 places, so 2 minutes, out of order
    folder = str(tmp_path / "in")
    late = ("u0", 999, start, "a", 5.0)
    for k in range(0, 240, 40):
        write(spark, folder, [*moved[k : k + 40], *([late] if k == 200 else [])])
        time.sleep(1.05)
    write(spark, folder, [("end", 1000, start + dt.timedelta(days=1), "a", 1.0)])
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = sorted((r.user_id, r.event_id, r.review_cnt, r.price_mean, r.price_std, r.cat_hist, r.history, r.late) for r in streams.drained(streams.ordered_profiles(stream, "5 minutes"), str(tmp_path)).collect())
    want, users = [], {}
    for user, event_id, ts, category, price in sorted(data, key=lambda r: (r[2], r[1])):
        past = users.setdefault(user, streams.Past(None))
        want.append((user, event_id, *past.row(), False))
        past.add(int(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000), event_id, category, price)
    assert got == sorted(want)


def test_absent_users_are_forgotten(spark, tmp_path):
    import datetime as dt
    import time

    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    folder = str(tmp_path / "in")
    for batch in ([("u", 1, t(0), "a", 1.0)], [("v", 2, t(30), "a", 1.0)], [("v", 3, t(200), "a", 1.0)], [("u", 4, t(201), "a", 1.0)], [("end", 5, t(900), "a", 1.0)]):
        write(spark, folder, batch)
        time.sleep(1.05)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = lambda idle, name: {r.event_id: r.review_cnt for r in streams.drained(streams.ordered_profiles(stream, "1 minute", idle), str(tmp_path / name)).collect()}
    assert run(None, "a") == {1: 0, 2: 0, 3: 1, 4: 1}
    assert run(60 * 60_000, "b") == {1: 0, 2: 0, 3: 0, 4: 0}


def test_calls_to_the_state_follow_users_not_events():
    """A thousand events of a user that wait in a thousand lots: one timer, and a few calls."""
    import pandas as pd

    calls = []

    class State:
        def __init__(self):
            self.held = None

        def __getattr__(self, name):
            def call(*given):
                calls.append(name)
                if name in ("update", "put", "appendList"):
                    self.held = given[0]
                return self.held is not None if name == "exists" else self.held

            return call

    class Handle:
        getValueState = getListState = getMapState = lambda self, *_: State()
        registerTimer = deleteTimer = lambda self, at: calls.append(at)

    class Now:
        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: 600_000

    user = streams.OrderedProfile()
    user.init(Handle())
    frame = pd.DataFrame({"event_id": range(1000), "ts": pd.to_datetime([i * 1_000_000 for i in range(1000)], unit="us"), "category": "a", "price": 1.0})
    list(user.handleInputRows(("u",), iter([frame]), None))
    got = pd.concat(list(user.handleExpiredTimer(("u",), Now(), Now())))
    assert got["event_id"].tolist() == got["review_cnt"].tolist() == list(range(600)) and len(calls) < 30
