"""The split way of every ordered computation equals the plain one."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators.history import with_history
from threadloom.operators.ordered import FEW_CHUNKS, chunk_count, first_per_group, ordered, with_row_index
from threadloom.operators.thinning import greedy_thin

LIMITS = [1000, 7]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    # One group holds more than a third of all rows, and most of its times are equal.
    data = [(i, 0 if i % 5 < 2 else rng.randint(1, 30), rng.choice([0, rng.randint(0, 300)]),
             rng.choice([None, i])) for i in range(400)]
    return spark.createDataFrame(data, "messageid long, g long, t long, v long").repartition(5).persist()


def by_group(rows):
    groups = {}
    for r in sorted(rows.collect(), key=lambda r: (r.t, r.messageid)):
        groups.setdefault(r.g, []).append(r)
    return groups


@pytest.mark.parametrize("limit", LIMITS)
def test_previous_last_count_position(spark, rows, limit):
    prepared = ordered(rows, ["g"], ["t", "messageid"], limit)
    assert prepared.split == (limit == 7)
    out = (prepared.with_previous("prev", "messageid", "v").with_running_last("last", F.col("v"))
           .with_running_count("n", F.col("v").isNotNull()).with_position("pos").plain())
    got = {r.messageid: r for r in out.collect()}
    assert len(got) == 400
    for group in by_group(rows).values():
        last, n = None, 0
        for i, r in enumerate(group):
            g = got[r.messageid]
            last, n = (r.v, n + 1) if r.v is not None else (last, n)
            assert (g.last, g.n, g.pos) == (last, n, i)
            assert g.prev == (None if i == 0 else (group[i - 1].messageid, group[i - 1].v))


def test_a_small_limit_makes_no_more_chunks_than_the_input_asks_for(spark):
    assert chunk_count(400, 7) == 59
    assert chunk_count(36_000_000, 50) == chunk_count(600_000, 20) == FEW_CHUNKS + 1
    assert chunk_count(10**10, 50) == chunk_count(10**10, 1_000_000) == 10_001
    rows = spark.range(5_000).withColumn("g", F.lit(0))
    assert ordered(rows, ["g"], ["id"], 1).rows.select("_chunk").distinct().count() <= FEW_CHUNKS + 1


def test_row_index(spark, rows):
    got = {r.messageid: r.row_index for r in with_row_index(rows, ["t", "messageid"]).collect()}
    expected = sorted(rows.collect(), key=lambda r: (r.t, r.messageid))
    assert got == {r.messageid: i for i, r in enumerate(expected)}


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("include_self", [False, True])
def test_history(spark, rows, limit, include_self):
    out = with_history(rows, ["g"], ["t", "messageid"], item="v", is_target=F.col("messageid") % 4 == 0,
                       lookback=5, include_self=include_self, max_group_rows=limit)
    assert set(out.columns) == {*rows.columns, "history"}
    got = {r.messageid: r.history for r in out.collect()}
    expected = {}
    for group in by_group(rows).values():
        for i, r in enumerate(group):
            if r.messageid % 4 == 0:
                frame = group[max(0, i - 5): i + 1 if include_self else i]
                expected[r.messageid] = [x.v for x in frame if x.v is not None]
    assert got == expected
    assert out.count() == 100


@pytest.mark.parametrize("limit, gap", [(1000, 0), (1000, 40), (20, 9), (3, 0)])
def test_thinning(spark, rows, limit, gap):
    got = {r.messageid for r in greedy_thin(rows, ["g"], gap, max_group_rows=limit).collect()}
    expected = set()
    for group in by_group(rows).values():
        last = None
        for r in group:
            if last is None or r.t - last > gap:
                last = r.t
                expected.add(r.messageid)
    assert got == expected


def test_thinning_of_nothing(spark, rows):
    assert greedy_thin(rows.filter("t < 0"), ["g"], 5).count() == 0


def test_first_per_group(spark, rows):
    out = first_per_group(rows, ["g"], [F.col("t").desc(), F.col("messageid").desc()], 4, F.col("messageid"))
    got = {(r.g, r.rank): r.messageid for r in out.collect()}
    expected = {(g, i + 1): r.messageid for g, group in by_group(rows).items()
                for i, r in enumerate(group[::-1][:4])}
    assert got == expected
