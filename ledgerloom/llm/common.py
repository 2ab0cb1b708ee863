"""Small helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python workers in batches of at most ``rows``, so that long texts do not add up.

    A session that has chosen another size than Spark's 10,000 keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder within the shared one that ``spark.checkpoint.dir`` names.

    Where none is named, a temporary folder in local mode, as in tests; on a cluster an error, since no executor can read
    what another wrote to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/ledgerloom-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.conf.get("ledgerloom.scratch", None)
    if not own:
        own = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("ledgerloom.scratch", own)
    return own


def stored(df: DataFrame, label: str, group_rows: int | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends in files any executor can reach.

    Readers hold up to 4,096 rows of a row group at once; ``group_rows`` bounds them for tables with rows of very many bytes.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    layout = {} if group_rows is None else {"parquet.block.row.count.limit": group_rows}
    df.write.option("compression", "zstd").options(**layout).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Results that were not written elsewhere can't be read after it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """True for the rows that learning may not see: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(labels: DataFrame, key: str, label: str, cells: int) -> list[tuple]:
    """At most ``cells`` (key, label) rows of each label, drawn by hash: the smallest hash of each cell.

    A minimum per cell combines on the map side, so a label with most of the rows is no hot group.
    """
    h = F.xxhash64(F.col(key).cast("string"))
    drawn = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(label, F.pmod(h, F.lit(cells)).alias("cell"))
    rows = drawn.agg(F.min(F.struct(h.alias("h"), F.col(key).alias("k"))).alias("m")).select(F.col("m.k").alias("k"), label, F.col("m.h").alias("h"))
    return [(r[0], r[1]) for r in sorted(rows.collect(), key=lambda r: (str(r[1]), r[2]))]
