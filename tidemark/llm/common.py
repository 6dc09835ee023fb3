"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: One word, as a Java and DuckDB pattern.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; one of its own only where all run on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: its lineage ends here and a lost executor costs nothing. See cleared()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Deletes the tables written by this application. Results that read them are to be stored before."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables/{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, row: beside it an operator's own columns cannot clash with any name in docs."""
    return F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row")


def unpacked(docs: DataFrame, text: Column | None = None) -> list[Column]:
    """The columns of docs out of row; with text, that is the new text and n_chars, if there, its length where it differs."""
    found = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if text is not None and c == "text":
            value = text
        elif text is not None and c == "n_chars":
            value = F.when(text.eqNullSafe(F.col("row").getField("text")), value).otherwise(F.length(text)).cast(docs.schema[c].dataType)
        found.append(value.alias(c))
    return found


def kept_where(rows: DataFrame, condition: Column) -> DataFrame:
    """rows.where(condition), with the columns of rows computed below and once.

    Spark pushes a filter below the columns it reads and computes them there again, inside lambdas even once an element.
    It pushes none below a column that is no function of the row.
    """
    return rows.withColumn("_task", F.spark_partition_id()).where(condition & (F.col("_task") >= 0)).drop("_task")


#: Bits of a bitmap of hashes: 2 MB, whatever goes into it.
BITS = 1 << 24


def perhaps_in(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """All rows whose key (a hash) is among wanted, and few others while wanted is small beside BITS: for use before a join with wanted.

    The bitmap has a bit for each value of a hash's last digits, so its broadcast is bounded however many are wanted.
    """
    place = lambda c: F.pmod(c, F.lit(BITS)) + 1
    bits = wanted.groupBy(F.bitmap_bucket_number(place(wanted_key)).alias("b_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(wanted_key))).alias("b_bits"))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("b_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place(key)) == F.col("b_bucket"))
    return there.where((F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1)).select(*rows.columns)


#: Bits of a bitmap that rides along with rows: 64 KB, whatever goes into it.
FEW_BITS = 1 << 19


def bitmap(wanted: DataFrame, key: Column) -> DataFrame:
    """One row, b_words: the last digits of all keys (hashes) of wanted as bits, for marked(). Its size hangs on nothing."""
    place = F.pmod(key, F.lit(FEW_BITS))
    own = wanted.select(F.floor(place / 64).alias("b_word"), (place % 64).cast("int").alias("b_at")).groupBy("b_word").agg(F.expr("bit_or(shiftleft(1L, b_at))").alias("b_bits"))
    every = wanted.sparkSession.range(FEW_BITS // 64).withColumnRenamed("id", "b_word").join(own, "b_word", "left")
    every = every.agg(F.array_sort(F.collect_list(F.struct("b_word", F.coalesce("b_bits", F.lit(0).cast("long")).alias("b_bits")))).alias("b"))
    return every.select(F.col("b.b_bits").alias("b_words"))


def marked(words: Column, key: Column) -> Column:
    """Whether a key may be among those of a bitmap; surely true if it is."""
    return let(F.pmod(key, F.lit(FEW_BITS)), lambda n: F.getbit(F.get(words, F.floor(n / 64).cast("int")), (n % 64).cast("int")) == 1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for a row, wherever and however often body uses it."""
    return F.transform(F.array(value), body)[0]


def sums_before(values: Column) -> Column:
    """For each number of an array the sum of those before it, in near-linear time: sums of blocks of 32, of these, and so on."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 32).cast("int")), lambda k: total(F.slice(x, k * 32 + 1, 32)))

    def each(a: Column, b: Column, c: Column, d: Column) -> Column:
        part = lambda x, i, unit: total(F.slice(x, (F.floor(i / (32 * unit)) * 32 + 1).cast("int"), (F.floor(i / unit) % 32).cast("int")))
        return F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: total(F.slice(d, F.lit(1), F.floor(i / 32768).cast("int"))) + part(c, i, 1024) + part(b, i, 32) + part(a, i, 1))

    some = let(values, lambda a: let(blocks(a), lambda b: let(blocks(b), lambda c: let(blocks(c), lambda d: each(a, b, c, d)))))
    return F.when(F.size(values) > 0, some).otherwise(F.array().cast("array<bigint>"))


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(plain, " "), "")


def numbered(df: DataFrame, order: list[str], name: str, column: str = "row_number") -> DataFrame:
    """df with global row numbers from 0 in the given order, nulls first.

    Rows are dealt by range, so no task sees more than its share; the offsets are a sum over one row a partition.
    Rows equal in all order columns are interchangeable. The range dealing is written once, so that a lost
    executor cannot renumber anything.
    """
    n = partitions(df.sparkSession)
    dealt = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), name)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.alias("a").join(F.broadcast(counts.alias("b")), F.col("b._part") < F.col("a._part"), "left")  # one row a partition
    offsets = offsets.groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    from pyspark.sql import Window

    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(column, F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")
