"""Session settings this library is written for."""

from pyspark.sql import SparkSession

# Fixed values. AQE does the run-time work: it sizes shuffle partitions, turns a
# sort-merge join into a broadcast one when the side turned out small, and splits
# the partitions of a hot join key.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A side too large to broadcast is hashed instead of sorting both, as long as
    # each of its shuffle partitions was measured to be no larger than this.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Tables bucketed by completion join by case and completion without a shuffle.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    # Call sites are not recorded per column, which halves the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master=None, shuffle_partitions=None, **more):
    """A session with the settings above.

    On a cluster leave `master` to spark-submit and set `shuffle_partitions` to a
    few per core (AQE merges the small ones). `more` takes further settings with
    `_` for `.`, e.g. ``spark_driver_memory="8g"``.
    """
    builder = SparkSession.builder.appName("fieldlens")
    if master is not None:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in more.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
