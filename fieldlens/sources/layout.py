"""The tables laid out for joins: a folder per case, and buckets by completion.

Fact rows of a completion lie in the bucket that its hierarchy row lies in, so the join of both and sums per completion move no fact
row. A task sorts or sums a bucket, so there are as many as the rows of the largest table ask for. A completion is in one bucket
whatever its size.
"""

import math
import tempfile
import uuid

from fieldlens.sources.tables import Tables, check_tables, rejects_of

# The columns that name a completion in each table.
BUCKET_COLUMNS = {
    "productiondata": ("WellAPI", "CompSubId"),
    "completiondata": ("WellAPI", "CompSubId"),
    "producer_timestep": ("WellId", "CompletionId"),
    "injector_timestep": ("WellId", "CompletionId"),
}
#: Rows that a bucket holds at most on average, and the fewest buckets.
ROWS, FEWEST = 1 << 20, 8
NAMES = ("productiondata", "completiondata", "fit_info", "producer_timestep", "injector_timestep")
# Without it a bucketed table is shuffled again for a join by its bucket columns and the case.
SETTING = "spark.sql.requireAllClusterKeysForCoPartition"


def work_folder(spark):
    """A folder that all executors see: `spark.checkpoint.dir` of the session.

    Only a session on one machine that names none, as in tests, gets a folder of its own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fieldlens-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def buckets_for(*frames):
    """How many buckets these tables need: by the rows of the largest, so that no task's share grows with them."""
    return max(FEWEST, math.ceil(max(frame.count() for frame in frames) / ROWS))


def write_layout(tables, folder, prefix, buckets=None):
    """Writes the five tables below `folder` and registers them as `{prefix}_{name}`; returns their names.

    Without `buckets` the rows of the bucketed tables are counted first.
    """
    buckets = buckets or buckets_for(*(getattr(tables, name) for name in BUCKET_COLUMNS))
    for name in NAMES:
        frame = getattr(tables, name)
        by = BUCKET_COLUMNS.get(name)
        if by is None:
            writer = frame.write
        else:
            # Each task writes one bucket, so a bucket has one file per case.
            writer = frame.repartition(buckets, *by).write.partitionBy("casename").bucketBy(buckets, *by).sortBy(*by)
        writer.format("parquet").option("path", f"{folder.rstrip('/')}/{name}").saveAsTable(f"{prefix}_{name}")
    return [f"{prefix}_{name}" for name in NAMES]


def read_layout(spark, prefix, check=True):
    """The tables that `write_layout` registered, as `load` gives them."""
    frames = {name: spark.table(f"{prefix}_{name}") for name in NAMES}
    tables = Tables(**frames, rejected=rejects_of(frames["productiondata"]))
    if check:
        check_tables(tables)
    return tables
