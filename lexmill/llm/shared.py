"""Helpers the operators share: stable row keys and tables in the cluster's shared folder."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship  # noqa: F401  used by the operators

#: Stands for a null id inside a plan; the caller's column is returned as it came.
NO_ID = -(2**63)
#: White space between words: space, tab, LF, VT, FF and CR.
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one of our own only where it is unset on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexmill-"))
    return named or context.getCheckpointDir()


#: Paths of the tables each application wrote.
_WRITTEN: dict[str, list[str]] = {}


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that the operators wrote so far; call it when their results have been stored."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back (its size is then known)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, which it does after a collection."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def own_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let the first argument have columns named like the operator's own (``_lm_...``): they are renamed meanwhile."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = {c: f"caller{i}{c}" for i, c in enumerate(docs.columns) if c.startswith("_lm_")}
        if not names:
            return operator(docs, *args, **kwargs)
        return operator(docs.withColumnsRenamed(names), *args, **kwargs).withColumnsRenamed({v: k for k, v in names.items()})

    return run


def whole_text(column: str | Column = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")
