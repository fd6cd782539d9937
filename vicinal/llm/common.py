"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that end a word, for translate().
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one for local runs where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="vicinal-"))
    return sc.getCheckpointDir()


#: Shuffle partitions that spool() puts in a file, if asked for few files.
PARTITIONS_A_FILE = 16


def spool(df: DataFrame, few: bool = False) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    The lineage ends here, so a lost executor costs no more than the tasks it
    was running, and later steps read only the columns that they need.

    A task writes a file, and for each one Hadoop starts six processes where the
    folder is local, which for narrow rows is most of the work. With few, rows
    are dealt evenly over fewer tasks to be written: one for so many shuffle
    partitions, and as many as there are cores at least.
    """
    spark = df.sparkSession
    if few:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        files = max(spark.sparkContext.defaultParallelism, partitions // PARTITIONS_A_FILE)
        df = df.repartition(files) if files < partitions else df
    path = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unspool(df: DataFrame) -> None:
    """Delete what spool() wrote, once nothing will read it again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/spool-" in path:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def aside(df: DataFrame, taken: Iterable[str], *columns: str) -> tuple:
    """(df, back, columns): df with columns of taken names under others, a function that gives them their names again, and columns as they are named now.

    So a table may have columns named like those that an operator works with.
    """
    taken, used = {t.lower() for t in taken}, {c.lower() for c in df.columns}
    names = {}
    for c in df.columns:
        if c.lower() in taken:
            new = f"{c}_"
            while new.lower() in taken | used:
                new += "_"
            used.add(new.lower())
            names[c] = new
    if not names:
        return df, lambda out: out, *columns
    old = {new: c for c, new in names.items()}
    moved = df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])
    return moved, lambda out: out.select(*[F.col(f"`{c}`").alias(old.get(c, c)) for c in out.columns]), *[names.get(c, c) for c in columns]


def positions(df: DataFrame, key: str, bucket: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 0, by (bucket, order), without a task that holds a key.

    key must not be null. Rows are numbered inside (key, bucket), and a running
    sum over the counts of a key's buckets gives where each bucket begins; the
    caller chooses the buckets so that a hot key falls into many.
    """
    counts = df.groupBy(key, *bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, *bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, *bucket).orderBy(*order)
    return (
        df.join(starts, [key, *bucket])
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_start")
    )


def spread(column: Column | str, n: int) -> Column:
    """A bucket from 0 to n - 1 for any value, by its MD5, so that SQL engines agree on it."""
    column = F.col(column) if isinstance(column, str) else column
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def n_words(column: Column | str) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit("")), F.lit(WORD)), F.lit(0)).cast("long")
