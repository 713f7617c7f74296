"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, whatever
they are named; the last one adds the pieces. Stages work on all that their
predecessor kept.

Cases, in all stages: an empty table gives an empty result; a null text counts as
one without words, which the first stage rejects; null and repeated ids are fine,
as decisions are made on rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import line_dedup, ngram_join, quality_rules, sentencepiece_paths, source_mixing
from wayloom.llm.common import documents, set_aside, shared_dir, written
from wayloom.llm.queries import PIECES, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and too short texts among them. Equal rows share their fate."""
    return quality_rules.kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; documents of which nothing is left go with them, and so do null texts.

    Rows of equal id and text are treated alike: near_copies keeps one of them.
    """
    kept = line_dedup.without_repeats(docs, results=("·lines", "·deleted", "·runs")).filter("`·lines` > `·deleted`")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the smallest id, or among rows of this id of the smallest hash.

    Ids that are null come last. A text without words is no copy of another and
    stays, as often as it is there; of other rows that are equal in all columns one
    stays.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.xxhash64(*names).alias("h1"), F.xxhash64(F.lit(1), *names).alias("h2"))
    keyed = docs.select(*names, key.alias("·key"))
    placed = written(ngram_join.near_duplicates(keyed, "·key"))
    copies = placed.filter("n_shingles > 0 AND component <> doc").select(F.col("doc").alias("·key")).distinct()
    equal = placed.filter("n_shingles > 0 AND component = doc").groupBy(F.col("doc").alias("·key")).count().filter("count > 1").select("·key")
    rest = keyed.join(copies, "·key", "left_anti")
    once = rest.join(equal, "·key", "left_semi").dropDuplicates(["·key"])
    return rest.join(equal, "·key", "left_anti").unionByName(once).select(*names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: documents left out go, those taken several times are repeated. Null sources are one more source."""
    own, back = set_aside(docs, ("mix_size", "mix_source_size", "mix_target", "mix_shards", "mix_shard", "mix_place"))
    return source_mixing.mixture(own).select(*back)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids, and whether they decode to the text: an empty text has none, a null text null ids."""
    both = sentencepiece_paths.encode(docs, tokenizer_file(PIECES), decoded="·decoded")
    return both.withColumn("round_trip", F.col("·decoded").eqNullSafe(F.col("text"))).drop("·decoded")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
