"""New content for users, asked for by many alike, against one user after another."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators import alerts

NOW = dt.datetime(2024, 1, 31)


def test_new_content(spark):
    rng = random.Random(2)
    content = [(i, rng.choice("ab"), rng.choice(["Solar power", "wind", "SOLAR", None, "gas"]), NOW - dt.timedelta(hours=rng.randint(0, 30))) for i in range(60)]
    words = [[], ["solar"], ["Solar", "SOLAR"], ["wind", "gas"], None, [None, "gas"], ["none"]]
    prefs = [(u, s, rng.choice(words)) for u in range(25) for s in "abc"]
    sent = [(rng.randint(0, 9), rng.randint(0, 59)) for _ in range(120)] * 2
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = alerts.new_content(df(prefs, "user_id int, source string, keywords array<string>"), df(content, "content_id int, source string, title string, created_at timestamp_ntz"), df(sent, "user_id int, content_id int"), F.lit(NOW).cast("timestamp_ntz"), "1 day", 3)
    want = []
    for user, source, keys in prefs:
        fits = lambda t: keys is not None and (not keys or any(k and t and k.lower() in t.lower() for k in keys))  # noqa: B023, E731
        new = sorted(((-at.timestamp(), i) for i, s, t, at in content if s == source and at > NOW - dt.timedelta(days=1) and fits(t) and (user, i) not in sent))
        want += [(user, i, n + 1) for n, (_, i) in enumerate(new[:3])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_a_user_who_had_nearly_everything(spark):
    content = [(i, "a", "t", NOW - dt.timedelta(minutes=i)) for i in range(100)]
    kind = "content_id int, source string, title string, created_at timestamp_ntz"
    prefs = spark.createDataFrame([(1, "a", []), (2, "a", [])], "user_id int, source string, keywords array<string>")
    sent = spark.createDataFrame([(1, i) for i in range(98)], "user_id int, content_id int")
    got = alerts.new_content(prefs, spark.createDataFrame(content, kind), sent, F.lit(NOW).cast("timestamp_ntz"), "1 day", 3).collect()
    assert sorted(tuple(r) for r in got) == [(1, 98, 1), (1, 99, 2), (2, 0, 1), (2, 1, 2), (2, 2, 3)]
