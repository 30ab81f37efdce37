"""Cut lineage: intermediate tables that are computed once and kept in a folder that driver and executors share.

They are written tables, not checkpointed plans: a checkpoint carries on the size that the optimizer guessed for its plan, and
in loops of joins these guesses multiply into numbers of millions of digits. A written table has its true size, by which
small ones are broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a task holds back before it writes them: these tables are read soon, and whole.
ROW_GROUP = 16 << 20
#: Shuffle partitions that ``cut_few`` leads into one file, where there are many.
PARTITIONS_A_FILE = 16
#: The tables written so far, for ``give_up``.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage: what the cluster names, else (a local session without the setting) a temporary one."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="veilspan-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder, so that a lost executor costs no recomputation of what led to it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_few(df: DataFrame) -> DataFrame:
    """``cut`` into few files, for small tables of which a loop writes many: at most two for each core, or a sixteenth of
    the shuffle partitions where that is more. Partitions are led together without a shuffle.

    A file costs its store several calls. On a local file system without Hadoop's native library these are programs that the
    executor starts (three for each file, to set permissions), and while one starts, its memory counts as the executor's twice.
    """
    spark = df.sparkSession
    most = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_A_FILE)
    return cut(df.coalesce(most))


def mark() -> int:
    """The place in the row of written tables up to which ``give_up`` keeps them."""
    return len(_made)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark reads, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def give_up(spark: SparkSession, since: int) -> None:
    """Deletes the tables written since ``mark``: once a result that came from them has been written, nothing reads them."""
    while len(_made) > since:
        remove(spark, _made.pop())
