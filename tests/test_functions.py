import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from seed import frame
from tradepost.functions import columns
from tradepost.functions.joins import first_per_key, reduced
from tradepost.functions.scan import new_ids, numbered, position, running_total


def hot_rows(n=500):
    """A third of the rows have key 1; a few have none."""
    rng = random.Random(7)
    return [(i, None if i % 50 == 0 else 1 if rng.random() < 0.34 else rng.randint(2, 40), rng.randint(1, 9)) for i in range(n)]


@pytest.mark.parametrize("most", [4, 1000])
def test_running_total(spark, limits, most):
    limits.window_rows = most
    rows = [r for r in hot_rows() if r[1] is not None]
    df = frame(spark, rows, "seq bigint, k bigint, v int")
    got = {r.seq: r.total for r in running_total(df, ["k"], "seq", F.col("v"), "total").collect()}
    sums, expected = {}, {}
    for seq, k, v in rows:
        sums[k] = expected[seq] = sums.get(k, 0) + v
    assert got == expected


def test_positions_and_ids_over_the_whole_table(spark, limits):
    limits.window_rows = 8
    df = frame(spark, [(i * 3,) for i in range(100)], "seq bigint")
    assert {r.seq: r.position for r in numbered(df, "seq").collect()} == {i * 3: i + 1 for i in range(100)}
    old = frame(spark, [(41,), (7,)], "id bigint")
    assert sorted(r.id for r in new_ids(df, old, "id", "seq").collect()) == list(range(42, 142))
    assert sorted(r.id for r in new_ids(df, old.limit(0), "id", "seq").collect()) == list(range(1, 101))


@pytest.mark.parametrize("most", [0, 1000])
def test_a_side_reduced_to_the_keys_of_a_batch(spark, limits, most):
    limits.broadcast_keys = most
    side = frame(spark, [(k, k * 2) for k in range(30)], "k bigint, v bigint")
    batch = frame(spark, [(3,), (3,), (7,), (99,), (None,)], "k bigint")
    assert sorted(r.k for r in reduced(side, batch, "k").collect()) == [3, 7]


def test_first_per_key(spark):
    df = frame(spark, [(3, "a"), (1, "a"), (2, "b")], "seq bigint, k string")
    assert {r.seq for r in first_per_key(df, "k").filter("is_first").collect()} == {1, 2}


def test_full_name_keeps_the_space(spark):
    df = frame(spark, [("A", "B"), (None, "B"), (None, None)], "first_name string, last_name string")
    assert [r[0] for r in df.select(columns.full_name()).collect()] == ["A B", " B", " "]


def test_mean_rounds_halves_up(spark):
    df = frame(spark, [(107, 40), (1, 3), (0, 0)], "s bigint, n bigint")
    got = [r[0] for r in df.select(columns.mean("s", "n").cast("decimal(5,2)")).collect()]
    assert got == [Decimal("2.68"), Decimal("0.33"), None]


def test_month_range_at_the_end_of_a_year(spark):
    df = spark.sql("select timestamp_ntz'2023-12-31 23:59:59' t union all select timestamp_ntz'2024-01-01' union all select timestamp_ntz'2023-12-01'")
    assert df.filter(columns.month_range("t", 2023, 12)).count() == 2


def test_extended_array(spark):
    df = frame(spark, [(["a"], ["b"]), (None, ["b"]), (["a"], None)], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(columns.extended("x", "y")).collect()] == [["a", "b"], ["b"], ["a"]]


def test_merged_partitions_stay_small(spark):
    # Packed keys take some five bytes a row in a shuffle and over a hundred in a task.
    assert spark._jsparkSession.sessionState().conf().getConfString("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"


def test_ingested_rows_are_judged_once(spark):
    from tradepost.sources import TABLES
    from tradepost.sources.ingest import ingest

    drawn = F.udf(lambda _: str(random.randint(1, 40)), "string").asNondeterministic()
    raw = spark.range(300).select(F.col("id").alias("seq"), drawn("id").alias("category_id"), F.lit("x").alias("name"))
    accepted, rejected = ingest(raw, TABLES["category"])
    kept = [r.category_id for r in accepted.collect()]
    assert len(kept) == len(set(kept)) <= 40 and len(kept) + rejected.count() == 300
