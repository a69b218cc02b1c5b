"""What the operators of this subpackage share: words, shared storage, row hashes."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.files import spread

#: Separators of words: space and the ASCII controls from tab to carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda over a one-element array binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SEPARATOR_RUN)),
    )


def count_words(text: Column) -> Column:
    """Number of words of a text, null counting as empty (long)."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS)),
        lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SEPARATOR_RUN))).cast("long"),
    )


def id_residue(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all run on this machine; a cluster has to name one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage.

    Losing an executor later costs nothing: the files are not on its disk. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillon/{uuid.uuid4().hex}"
    df.write.parquet(passing(spark, path))
    return spark.read.schema(df.schema).parquet(path)


def passing(spark: SparkSession, path: str) -> str:
    """The path of a folder that goes when the driver ends."""
    if not _written:
        atexit.register(_forget)
    _written.append((spark, path))
    return path


def _forget() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended before
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; over all cores if its file has fewer parts than there are cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small(rows: DataFrame, limit: int) -> DataFrame:
    """`rows` marked for broadcast if a count shows that they are at most `limit`, else as they are, for a join by shuffle."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows, those whose hashed key is least: the same rows in every run."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(limit)
