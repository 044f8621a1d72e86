"""What the operators of this subpackage share: durable tables and Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only on one machine, where it names none (as in tests), is a temporary folder taken; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="skarn-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Folders that each session has made, by the session's own id.
MADE: dict[str, list[str]] = {}


def made_by(spark: SparkSession) -> list[str]:
    return MADE.setdefault(spark._jsparkSession.sessionUUID(), [])


def new_folder(spark: SparkSession, name: str) -> str:
    made_by(spark).append(f"{shared_folder(spark)}/skarn-{name}-{uuid.uuid4().hex}")
    return made_by(spark)[-1]


def release(spark: SparkSession) -> int:
    """Deletes the intermediate folders of this session, once their results are written elsewhere; those of others stay."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    made = made_by(spark)
    while made:
        path = jvm.org.apache.hadoop.fs.Path(made.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back.

    Later stages start from these files, so a lost executor costs no earlier work, and
    what is not deterministic in a plan is settled once.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, make: Callable[[], Callable], schema) -> DataFrame:
    """Maps record batches; ``make()`` runs once in a task and gives the batch function.

    The batch function gets a ``pyarrow.RecordBatch`` and yields record batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from step(batch)

    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, column: str, make: Callable[[], Callable]) -> DataFrame:
    """The rows for which ``make()`` gives true; it gets lists of the column's values."""
    at = df.columns.index(column)

    def outer():
        accept = make()

        def step(batch: pa.RecordBatch):
            yield batch.filter(pa.array(accept(batch.column(at).to_pylist()), pa.bool_()))

        return step

    return arrow_map(df, outer, df.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
