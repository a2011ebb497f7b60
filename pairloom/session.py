"""Session, table access and size-checked physical hints shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast; both are checked before the hint is given.
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 16 << 20


def build_session(app: str = "pairloom", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster the master and memory come from spark-submit."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data folder (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as spark.checkpoint.dir names it.

    Only a local master, whose tasks all run on this machine, may do without: it gets a folder of its own. Elsewhere an unset
    folder is an error, since executors would write to their own disks.
    """
    sc = spark.sparkContext
    jdir = sc._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), f"pairloom-{uuid.uuid4().hex}")
        _delete_on_exit(spark, where)
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by an eager, reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder: compressed and read by columns, for results that are large or used in parts."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most `rows` rows and about `size` bytes (strings and arrays of numbers counted, other columns as 8 bytes); reads no more than rows + 1 rows past df's own plan."""
    strings = [c for c, t in df.dtypes if t == "string"]
    arrays = [c for c, t in df.dtypes if t.startswith("array<") and t[6:-1] in ("double", "float", "int", "bigint")]
    rest = 8 * (len(df.columns) - len(strings)) + 16
    width = F.lit(rest)
    for c in strings:
        width = width + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) + 8
    for c in arrays:
        width = width + 8 * F.greatest(F.size(F.col(f"`{c}`")), F.lit(0))
    n, b = df.select(width.cast("long").alias("w")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return n <= rows and b <= size


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is measured small, else unchanged: the join then shuffles, and AQE splits skewed partitions."""
    return F.broadcast(df) if is_small(df, rows, size) else df


#: Keys of a large side that are broadcast because they are the most frequent ones, and their longest text.
FREQUENT, FREQUENT_BYTES = 50_000, 200


def frequent_join(fact: DataFrame, side: DataFrame, key: str, freq: str, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """Inner join of a fact table, whose text keys may be very skewed, to a side that has each key once with its number of fact rows.

    A measured-small side is broadcast. Otherwise its most frequent keys are, whose number and length are bounded, and only
    the rows of other keys are shuffled: each of those keys has at most one in `frequent` of all rows, so none is hot.
    A frequent key longer than FREQUENT_BYTES stays in the shuffle, where AQE splits its partition. Null keys match nothing.
    """
    if is_small(side, rows, size):
        return fact.join(F.broadcast(side), key)
    head = cut(side.where(F.octet_length(key) <= FREQUENT_BYTES).orderBy(F.col(freq).desc(), key).limit(frequent))
    tail = side.join(F.broadcast(head.select(key)), key, "left_anti")
    return fact.join(F.broadcast(head), key).unionByName(fact.join(F.broadcast(head.select(key)), key, "left_anti").join(tail, key))
