"""Heavy-key paths give the same rows as the plain windows and as a loop in Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from jobscope.operators import ordered

KEY = ["k"]
ORDER = ["ts", "id"]


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(200)}"
        ts = start + dt.timedelta(seconds=rnd.randrange(5 * 86400))
        rows.append((key, ts, i, f"v{i}" if rnd.random() < 0.3 else None))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id bigint, v string")
    return df, rows


@pytest.fixture(scope="module")
def heavy(data):
    return ordered.heavy_slices(data[0], KEY, "ts", rows_per_slice=100, small_bytes=0)


def test_heavy_keys_found(heavy):
    found = heavy.collect()
    assert [r.k for r in found] == ["hot"] and len(found[0]._cuts) >= 5


def test_small_inputs_are_not_counted(data):
    assert ordered.heavy_slices(data[0], KEY, "ts") is None


def test_inputs_without_heavy_keys(data):
    assert ordered.heavy_slices(data[0], KEY, "ts", rows_per_slice=100_000, small_bytes=0) is None


@pytest.fixture(scope="module")
def odd(spark):
    """Null keys, keys above 2^53, null times, and all rows of a key within one hour."""
    rnd = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        key = rnd.choice([None, None, 2**53, 2**53 + 1, 7])
        spread = 3600 if key == 7 else 40 * 3600
        rows.append((key, None if rnd.random() < 0.05 else start + dt.timedelta(seconds=rnd.randrange(spread)), i, f"v{i}" if i % 3 else None))
    df = spark.createDataFrame(rows, "k bigint, ts timestamp_ntz, id bigint, v string")
    return df, rows, ordered.heavy_slices(df, KEY, "ts", rows_per_slice=60, small_bytes=0)


def test_odd_keys_and_times_agree_on_both_paths(odd, rows):
    df, raw, heavy = odd
    assert heavy.count() >= 4
    for call in (
        lambda h: ordered.with_neighbours(df, KEY, ORDER, next_of={"n": "id"}, previous_of={"p": "id"}, heavy=h),
        lambda h: ordered.with_row_number(df, KEY, ORDER, "rn", heavy=h),
        lambda h: ordered.with_last_seen(df, KEY, ORDER, "v", "s", heavy=h),
    ):
        plain = call([])
        assert rows(plain) == rows(call(heavy).select(plain.columns))
    timed = [(r[0] if r[0] is not None else -1, *r[1:]) for r in raw if r[1] is not None]
    for within in (60, 7200):
        want = sorted(((None if k == -1 else k, t, i) for k, t, i in greedy(timed, within)), key=repr)
        for chosen in ([], heavy):
            assert rows(ordered.unique_within(df, "k", "ts", "id", within, heavy=chosen)) == want


def test_neighbours(data, heavy, rows):
    df, _ = data
    args = dict(next_of={"n": "id", "nv": "v"}, previous_of={"p": "id"})
    plain = ordered.with_neighbours(df, KEY, ORDER, heavy=[], **args)
    sliced = ordered.with_neighbours(df, KEY, ORDER, heavy=heavy, **args)
    assert rows(plain) == rows(sliced.select(plain.columns))


def test_row_number(data, heavy, rows):
    df, _ = data
    plain = ordered.with_row_number(df, KEY, ORDER, "rn", heavy=[])
    sliced = ordered.with_row_number(df, KEY, ORDER, "rn", heavy=heavy)
    assert rows(plain) == rows(sliced.select(plain.columns))


def test_last_seen(data, heavy, rows):
    df, _ = data
    plain = ordered.with_last_seen(df, KEY, ORDER, "v", "s", heavy=[])
    sliced = ordered.with_last_seen(df, KEY, ORDER, "v", "s", heavy=heavy)
    assert rows(plain) == rows(sliced.select(plain.columns))


def greedy(rows, within, last=None):
    kept, state = [], dict(last or {})
    for key, ts, i, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in state or ts - state[key] >= dt.timedelta(seconds=within):
            state[key] = ts
            kept.append((key, ts, i))
    return sorted(kept, key=repr)


@pytest.mark.parametrize("within", [60, 1800, 3600, 5400, 40000])
def test_unique_within(data, heavy, rows, within):
    df, raw = data
    want = greedy(raw, within)
    assert rows(ordered.unique_within(df, "k", "ts", "id", within, heavy=[])) == want
    assert rows(ordered.unique_within(df, "k", "ts", "id", within, heavy=heavy)) == want


@pytest.mark.parametrize("within", [1800, 40000])
def test_unique_within_carries_on(data, heavy, rows, spark, within):
    df, raw = data
    last = {"hot": dt.datetime(2024, 1, 1, 5), "k1": dt.datetime(2024, 1, 2)}
    frame = spark.createDataFrame(list(last.items()), "k string, ts timestamp_ntz")
    want = greedy(raw, within, last)
    for chosen in ([], heavy):
        assert rows(ordered.unique_within(df, "k", "ts", "id", within, last_kept=frame, heavy=chosen)) == want


def test_streamed_rows_are_clustered_by_a_window(data, heavy):
    """A plain repartition may be dropped or split by adaptive execution; a window's need may not."""
    plan = ordered.unique_within(data[0], "k", "ts", "id", 60, heavy=heavy)._jdf.queryExecution().sparkPlan().toString()
    lines = [line.strip(" :+-") for line in plan.splitlines()]
    below = [lines[i + 1] for i, line in enumerate(lines) if line.startswith(("MapInPandas", "MapInArrow"))]
    assert len(below) == 2 and all(line.startswith("Window") for line in below)


def test_exact_percentile(data, spark):
    from jobscope.operators.stats import exact_percentile

    rnd = random.Random(3)
    values = [(g, rnd.choice([1.0, 2.5, 7.25, rnd.random() * 50])) for g in "ab" for _ in range(501)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {r.g: r.p for r in exact_percentile(df, "g", "v", 0.95, "p").collect()}
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", 0.95).alias("p")).collect()}
    assert got == pytest.approx(want)


def test_exact_percentile_of_the_null_group(spark):
    from jobscope.operators.stats import exact_percentile

    df = spark.createDataFrame([(None, float(i)) for i in range(11)] + [("a", 1.0)], "g string, v double")
    assert {r.g: r.p for r in exact_percentile(df, "g", "v", 0.5, "p").collect()} == {None: 5.0, "a": 1.0}
