"""Tables that cut lineage, kept in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

#: Whether Spark removes the shuffle files of a query as soon as it has ended (its stages can still be run again).
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The words of a text are the maximal runs of other characters than these (Java and RE2 syntax).
WORD = "[^\\x20\\x09-\\x0D]+"


def ship(spark: SparkSession) -> None:
    """Let Python workers that see this folder import the package; elsewhere submit it with ``--py-files``."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if top not in known:
        env["PYTHONPATH"] = os.pathsep.join([top, *filter(None, known)])


class Scratch:
    """Written tables of one operator call.

    ``write`` materializes a frame (later readers do not depend on the executors that made it) and ``drop``
    deletes one that nothing reads any more. Both go through Hadoop's file systems, so the folder may be in
    any store that Spark can write.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex[:12]}"

    def path(self, part: str) -> str:
        return f"{self.base}/{part}"

    def write(self, df: DataFrame, part: str, codec: str = "zstd") -> DataFrame:
        """``df`` as a table. The shuffles that made it are needed no more once it is written, and their files are removed then."""
        path, conf = self.path(part), self.spark.conf
        before = conf.get(CLEAN_UP, "false")
        conf.set(CLEAN_UP, "true")
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            conf.set(CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, part: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(part))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def n_words(text) -> F.Column:
    """Number of words of a text, 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
