"""One well with a third of everything: results stay whole and no task gets it all."""

import random

import pytest
from frames import PRODUCTION_DEFAULTS, completion, rows
from pyspark.sql import functions as F

from fieldlens.operators import options, series, summary, totals
from fieldlens.operators.grouping import depth_bin, number_along


@pytest.fixture(scope="module")
def hot(spark):
    """30,000 rows, a third of them in one month of one completion."""
    is_hot = F.col("id") % 3 == 0
    well = F.when(is_hot, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 50))
    month = F.when(is_hot, 1).otherwise((F.col("id") % 12 + 1).cast("int"))
    own = {"WellAPI": well, "Month": month, "Qo": (F.col("id") % 4).cast("double")}
    rest = {name: F.lit(value) for name, value in PRODUCTION_DEFAULTS.items() if name not in own}
    return spark.range(30000).select(*[value.alias(name) for name, value in {**rest, **own}.items()])


@pytest.fixture
def merged_joins(spark):
    """Joins as for sides too large to broadcast."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def _completions(spark):
    return completion(spark, {"WellAPI": "hot", "WellName": "Hot"}, *[{"WellAPI": f"w{i}", "WellName": f"Well {i}"} for i in range(50)])


def test_hot_well_with_merged_joins(spark, hot, merged_joins):
    comp = _completions(spark)
    expected = sum(i % 4 for i in range(30000))
    actual = series.actual_series(hot, comp, "oil", ["WellAPI"], ordered=False)
    assert actual.agg(F.sum("oil")).first()[0] == expected
    hot_sum = sum(i % 4 for i in range(0, 30000, 3))
    assert rows(actual.filter("WellAPI = 'hot'"), "oil", "wellcount") == [(float(hot_sum), 1)]
    top = totals.top_wells(hot, comp, 1).first()
    assert top.WellName == "Hot" and top.oil_cum == pytest.approx(hot_sum * 31 * 1e-3)
    assert summary.count_wells(hot).first().total_wells == 51
    assert options.well_options(hot, comp).count() == 51
    fanned = series.production_by_month(hot, comp, fanout=True)
    assert fanned.agg(F.sum("oil")).first()[0] == expected


def test_numbering_splits_a_hot_key(spark):
    rng = random.Random(7)
    values = [None, float("nan"), float("inf"), -float("inf"), 0.0, -1e-300, 1e300, *(rng.uniform(-9000, 9000) for _ in range(900)), *range(400)]
    shuffled = [(f"k{i % 40}" if i % 3 else "hot", rng.choice(values), i) for i in range(6000)]
    frame = spark.createDataFrame([(k, None if v is None else float(v), f"{i:05}") for k, v, i in shuffled], "k string, v double, tie string").repartition(8)
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup())
    numbered = number_along(frame, ["k"], "v", "tie", "n")
    assert len(jobs.getJobIdsForGroup()) == before
    got = {key: [] for key, _, _ in shuffled}
    for row in numbered.orderBy("n").collect():
        got[row.k].append((row.n, row.tie))
    last = lambda v: (v is None, v is not None and v != v, v if v is not None and v == v else 0)
    for key, pairs in got.items():
        ties = [f"{i:05}" for _, i in sorted(((last(v), i) for k, v, i in shuffled if k == key))]
        assert pairs == list(enumerate(ties, start=1))


def test_a_hot_well_lies_in_many_bins(spark):
    """No bin of the histogram holds more than a small share of a well that is drilled evenly."""
    depths = spark.range(100_000).select((F.col("id") * 0.05 + 3000).alias("td"))
    sizes = [row["count"] for row in depths.groupBy(depth_bin(F.col("td"))).count().collect()]
    assert len(sizes) > 1000 and max(sizes) < 200
