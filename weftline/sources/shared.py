"""Tables and small files in the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it. Only a local session without one gets a temporary folder, which is set as its checkpoint folder."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def place_for(spark: SparkSession, kind: str, *names: str) -> str:
    """A path in the shared folder that is the same for the same names."""
    return f"{shared_dir(spark)}/{kind}-{hashlib.sha1('|'.join(names).encode()).hexdigest()[:16]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, **options: object) -> DataFrame:
    """``df`` written as Parquet (with the writer's ``options``) in the shared folder and read again, so that lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


def removed(spark: SparkSession, path: str) -> bool:
    """Removes a table or file; tells whether it was there."""
    fs, target = file_system(spark, path)
    return fs.delete(target, True)


def moved(spark: SparkSession, path: str, target: str) -> bool:
    """Moves a table to a place where there is none yet; tells whether it did. Where one came there meanwhile, that one stays."""
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.NONE
    fs, source = file_system(spark, path)
    place = fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(target))
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(fs.makeQualified(source), place, options)
    except Py4JJavaError:
        if not fs.exists(place):
            raise
        return False
    return True


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, the oldest first."""
    fs, target = file_system(spark, path)
    return [s.getPath().getName() for s in sorted(fs.listStatus(target), key=lambda s: (s.getModificationTime(), s.getPath().getName()))]


def swapped(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place of another at once: readers see the old one or the new one, whole."""
    jvm, beside = spark._jvm, f"{path}.{uuid.uuid4().hex}"
    fs, source = file_system(spark, beside)
    out = fs.create(source, True)
    out.write(bytearray(text.encode()))
    out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(fs.makeQualified(source), fs.makeQualified(target), options)


def content_mark(df: DataFrame) -> str:
    """Row count and an order-insensitive hash of all columns, as one text: whether a table has changed."""
    hashed = F.xxhash64(*[F.coalesce(F.xxhash64(F.lit(i), c), F.lit(0)) for i, c in enumerate(df.columns)])
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(hashed.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("mark")).first()
    return f"{r['n']}-{r['mark']}"
