"""Intermediate and stored tables, written where every executor can read them again."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType, VariantType

#: By application, name and contents of the inputs: where a plane is, and its columns.
_STORED: dict[tuple[str, str, str], tuple[str, StructType]] = {}
#: Contents by application and what is seen of the files without reading them.
_CONTENTS: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local master uses ``/tmp/checkpoints``, and any other master the warehouse
    folder, if that isn't one of the driver's own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return "/tmp/checkpoints"
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return warehouse


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/wayfold-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = _path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _in_store(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark's own readers see them."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application has written; what reads them can't be used after that."""
    store, path = _in_store(spark, f"{shared_folder(spark)}/wayfold-{spark.sparkContext.applicationId}")
    store.delete(path, True)
    for known in (_STORED, _CONTENTS):
        for key in [k for k in known if k[0] == spark.sparkContext.applicationId]:
            del known[key]


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows of df whatever their order and partitions: their number and two sums of row hashes, and the columns.

    Each partition adds up its own, so only numbers are moved.
    """
    plain = [F.to_json(f"`{f.name}`") if isinstance(f.dataType, MapType | VariantType) else F.col(f"`{f.name}`") for f in df.schema]
    # nulls don't change a hash, so where they are is hashed too
    nulls = F.array(*[F.col(f"`{c}`").isNull() for c in df.columns])
    sums = [F.sum(F.xxhash64(F.lit(seed), nulls, *plain).cast("decimal(38,0)")) for seed in (1, 2)]
    row = df.agg(F.count("*"), *sums).first()
    return hashlib.sha256("\n".join([df.schema.json(), *map(str, row)]).encode()).hexdigest()


def contents(spark: SparkSession, path: str) -> str:
    """The fingerprint of a Parquet table. It is computed again only when names, sizes or times of its files have changed."""
    store, there = _in_store(spark, path)
    if store.exists(there) and store.getFileStatus(there).isFile():
        status = store.getFileStatus(there)
        seen = f"{path} {status.getLen()} {status.getModificationTime()}"
    else:
        seen = _listed(spark, path)
    key = (spark.sparkContext.applicationId, hashlib.sha256(seen.encode()).hexdigest())
    if key not in _CONTENTS:
        _CONTENTS[key] = fingerprint(spark.read.parquet(path))
    return _CONTENTS[key]


def _listed(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of all files of a table; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return "\n".join(sorted(map(str, files.collect())))  # a line a file of one table


def once(spark: SparkSession, name: str, inputs: Sequence[str], build: Callable[[], DataFrame], partition: Sequence[str] = ()) -> DataFrame:
    """A stored plane: built and written at its first use in an application, read from there after that.

    The key is what the input tables hold: a file that is overwritten makes another plane, one that is written
    again with the same rows doesn't. A plane whose folder is gone is built again. Partition columns
    become folders, one file each and task, so that a range of days reads only its own; adaptive execution splits
    what is large, so that no task sorts a whole busy day.
    """
    key = (spark.sparkContext.applicationId, name, " ".join(contents(spark, p) for p in inputs))
    if key in _STORED:
        path, schema = _STORED[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            del _STORED[key]
    df = build()
    path = _path(spark, name)
    rows = df.hint("rebalance", *partition) if partition else df
    (rows.write.partitionBy(*partition) if partition else rows.write).parquet(path)
    _STORED[key] = path, df.schema
    return spark.read.schema(df.schema).parquet(path)
