import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.functions.rows import numbered, reordered, with_partners
from tablewarden.operators import importance, models


@pytest.mark.parametrize("total", [1, 2, 3, 4, 5, 16, 17, 64, 65, 1000, 100_003])
def test_orders_are_bijections(total):
    rows = np.arange(total)
    orders = [reordered(rows, total, key) for key in range(3)]
    for order in orders:
        assert np.array_equal(np.sort(order), rows)
    if total >= 1000:
        for order in orders:
            assert abs(np.abs(order - rows).mean() / total - 1 / 3) < 0.05  # a random order moves by a third
            assert (order == rows).sum() < 10
        assert (orders[0] == orders[1]).mean() < 0.01


def test_places_do_not_depend_on_the_batch():
    rows = np.arange(5000)
    whole = reordered(rows, 5000, 7)
    assert np.array_equal(whole[1234:2000], reordered(rows[1234:2000], 5000, 7))


def test_small_orders_are_fair():
    # All 6 orders of three rows come about equally often over 3,000 keys.
    seen = [tuple(reordered(np.arange(3), 3, key)) for key in range(3000)]
    counts = [seen.count(o) for o in set(seen)]
    assert len(counts) == 6 and min(counts) > 400 and max(counts) < 600


def test_numbers_have_no_gaps(spark):
    df = spark.range(0, 1000, 1, 7).where("id % 3 = 0 or id > 900").withColumnRenamed("id", "row")
    rows, total = numbered(df)
    found = rows.select("row", F.col("own.row").alias("v")).collect()
    assert total == df.count() == len({r["v"] for r in found})
    assert sorted(r["row"] for r in found) == list(range(total))


def test_every_row_is_a_partner_once_per_repeat(spark):
    df = spark.range(0, 500, 1, 5).selectExpr("id as repeat", "cast(null as string) as partner")
    found = with_partners(df, 4, 1).select("row", "repeat", "own.repeat", "partner.repeat").toDF("row", "r", "own", "other").toPandas()
    assert len(found) == 2000
    for _, part in found.groupby("r"):
        assert sorted(part["own"]) == sorted(part["other"]) == list(range(500))
    assert with_partners(df.where("false"), 4, 1).count() == 0


def test_partners_come_from_other_partitions(spark):
    """A feature that is constant within each partition still loses its use when it is shuffled."""
    df = spark.range(600).selectExpr("cast(id % 2 as double) as x", "rand(3) as z", "if(id % 2 = 0, 'a', 'b') as y")
    model, ready, _ = models.train_baseline(df, "y", "classification")
    apart = ready.data.select("features", "label").repartitionByRange(2, "label")
    loss = importance.permutation(ready, model, apart)
    assert loss["x"] == pytest.approx(0.5, abs=0.08) and loss["z"] < 0.05
