"""Session settings and the shared folder used for anything a job writes."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot key is split even where that costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # too large to broadcast, but every partition fits in memory: no sort of the other side
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# what two splits of the usual size hold
SPREAD_BYTES = 256 << 20
# bytes planned for one part of a table that many more rows are made of; texts take about four times as many
PART_BYTES = 4 << 20
# what a task reads of small files
FILES_BYTES = 32 << 20
# planning takes rows that come from no file for larger than any table
UNKNOWN_BYTES = 1 << 50


def local_session(cores="*", shuffle_partitions=8, memory="16g"):
    """Session for tests and benchmarks; clusters bring their own master and sizes."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scriptorium")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark, label):
    """A new folder name below ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it then gets a scratch
    folder. On a cluster a machine-local folder would be lost with its executor,
    so the missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return os.path.join(root, f"{label}-{uuid.uuid4().hex}")


def apply_settings(spark):
    """Set what the operators rely on in a session made elsewhere, such as on a cluster."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def planned_bytes(df):
    """Bytes of a table as planning estimates them, from the sizes of its files; nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_of(df, part_bytes=PART_BYTES):
    """How many parts of bounded size ``df`` makes; as many as there are cores at least.

    Where a task makes many rows of each it reads, its memory follows its part, and the session's number
    of shuffle partitions does not grow with the table. That number serves where the size is not known.
    """
    spark, size = df.sparkSession, planned_bytes(df)
    if size >= UNKNOWN_BYTES:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, -(-size // part_bytes))


def unsorted(small):
    """The right side of a join that has one row per key and is far smaller than the left.

    If it is planned too large to be broadcast its parts become hash tables, so that the left side is not
    sorted, and not spilled for that.
    """
    size = planned_bytes(small)
    most = small.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return small.hint("shuffle_hash") if most < size < UNKNOWN_BYTES else small


def by_bytes(files, size):
    """Small files dealt to tasks by the ``size`` bytes they hold; nothing is exchanged.

    Spark counts each file as 4 MB and gives a task 32 of them, so that millions would mean a hundred
    thousand tasks. Four tasks a core are left at least, where Spark plans as many.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(4 * cores, -(-size // FILES_BYTES)))


def spread(scan):
    """Use all cores on a table of files that is too small to come in as many splits.

    Judged by the bytes of its files, which planning knows, so nothing runs for it; over
    ``SPREAD_BYTES`` it passes unchanged, so this never adds an exchange of a large table.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if planned_bytes(scan) < SPREAD_BYTES else scan
