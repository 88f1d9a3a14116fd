"""Tables that cut lineage: written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

_OWN: list[str] = []
_FOLDERS: dict[str, str] = {}


#: Bytes of rows for a byte of a compressed Parquet file of keys and names, for Spark's size checks.
EXPANSION = 8


def sized(spark: SparkSession) -> SparkSession:
    """Let Spark reckon tables by their rows, not by their compressed files: else it broadcasts some ten times what it allows, by way of the driver and into every task that joins them."""
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(EXPANSION))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    On one machine without it, a temporary folder that is removed at exit; a
    cluster without it is refused, since executors would write to disks of
    their own.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="shared-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return _OWN[0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except (Py4JError, OSError, AttributeError):  # the JVM is gone
        pass


def _folder(spark: SparkSession) -> str:
    """This application's own folder within the shared one; what is left in it goes at exit."""
    name = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if name not in _FOLDERS:
        _FOLDERS[name] = f"{name}-{uuid.uuid4().hex[:8]}"
        atexit.register(_at_exit, spark, _FOLDERS[name])
    return _FOLDERS[name]


def stored(df: DataFrame) -> DataFrame:
    """Write a table and read it back: loops neither grow their plans nor compute a round twice, and lost executors don't matter."""
    spark = sized(df.sparkSession)
    path = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Remove the files of ``stored`` tables that nothing reads any more."""
    for df in tables:
        if df is not None:
            own = _folder(df.sparkSession).removeprefix("file://")
            for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if "/table-" in name and own in name:
                    _delete(df.sparkSession, name)


def small_table(spark: SparkSession, columns: dict[str, list], schema: str | StructType) -> DataFrame:
    """A table of the driver's values by Arrow: a local relation, so that no Python worker starts for it and its size is known to the plan."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(columns[f.name], to_arrow_type(f.dataType)) for f in kind], names=kind.names), kind)


def small_rows(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """``small_table`` from rows."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return small_table(spark, dict(zip(kind.names, map(list, zip(*rows)))) if rows else {n: [] for n in kind.names}, kind)
