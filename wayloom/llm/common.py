"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: White space of the word definition: space and the control characters tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"

_LOCAL_DIRS: dict[str, str] = {}
HOT_ROWS = 256  # a key of fewer rows is never hot


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master, as in tests, may go without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="wayloom-")
    return f"file://{_LOCAL_DIRS[app]}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wayloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that written() made and nobody reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark).removeprefix("file://")
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if root in folder and "/wayloom-" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """rows joined with a table of one row a key; n, which goes, is the number of rows that have the key.

    A key of more than the 8 P-th part of all these rows (P: shuffle partitions) is
    hot. There are fewer than 8 P hot keys, so they are broadcast, and no task gets
    all rows of one; the others are shuffled. Both inputs are read more than once.
    """
    parts = shuffle_parts(rows.sparkSession)
    total = table.agg(F.sum(n)).first()[0] or 0
    most = max(HOT_ROWS, total // (8 * parts))
    hot, cold = table.filter(F.col(n) > most).drop(n), table.filter(F.col(n) <= most).drop(n)
    if total <= most:
        return rows.join(cold, keys)
    marked = rows.join(F.broadcast(hot.select(*keys).withColumn("·hot", F.lit(True))), keys, "left")
    return rows.join(F.broadcast(hot), keys).unionByName(marked.filter("`·hot` IS NULL").drop("·hot").join(cold, keys))


def set_aside(docs: DataFrame, names) -> tuple[DataFrame, list[Column]]:
    """docs with the columns that clash with names renamed, and the columns that give them back."""
    clash = {c: f"·own {c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(clash), [F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns]


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that were written and forgotten."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words_of(text: Column) -> Column:
    """The words of a text as an array, empty where it is null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_fields(schema: StructType, **kinds: str) -> StructType:
    """A new schema with more fields; StructType.add would change a data frame's own."""
    out = StructType(list(schema.fields))
    for name, kind in kinds.items():
        out.add(name, DataType.fromDDL(kind))
    return out


def map_arrow(df: DataFrame, run, schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any name, also with dots; run reads columns by place."""
    import pyarrow as pa

    names = [f"c{k}" for k in range(len(schema.fields))]
    plain = StructType([StructField(n, f.dataType) for n, f in zip(names, schema.fields, strict=True)])

    def renamed(frames):
        for batch in run(frames):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(renamed, plain).toDF(*schema.names)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Memo(dict):
    """A dict for memoised results in two generations, so that its memory stays bounded; results of keys longer than longest aren't kept."""

    def __init__(self, compute, limit: int, longest: int = 1 << 30):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def batches(rows: Iterator, limit: int) -> Iterator[list]:
    """Lists of at most limit rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= limit:
            yield held
            held = []
    if held:
        yield held
