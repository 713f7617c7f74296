"""Graphs as Parquet tables with a JSON description beside them."""

from __future__ import annotations

import json

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions.values import Registry

VERSION = 1


def store(tables: dict[str, DataFrame], path: str, registry: Registry | None = None) -> None:
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    about = json.dumps({"version": VERSION, "tables": sorted(tables), "values": registry.to_json() if registry else None})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], Registry | None]:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    if about["version"] != VERSION:
        raise ValueError("the graph was written by another version")
    return {name: spark.read.parquet(f"{path}/{name}") for name in about["tables"]}, Registry.from_json(about["values"]) if about["values"] else None


# Weights of shortcuts are kept in thousandths, in 32 bits.
LEAST_WEIGHT, MOST_WEIGHT = 1, (1 << 31) - 1


def stored_weight(weight: Column) -> Column:
    """A weight as it reads back: in thousandths, at least one of them, endless where it doesn't fit."""
    kept = F.greatest(F.round(weight * 1000), F.lit(float(LEAST_WEIGHT)))
    return F.when(kept < MOST_WEIGHT, kept / 1000).otherwise(F.lit(float("inf")))


def store_hierarchy(levels: DataFrame, ch_arcs: DataFrame, path: str, profile: str) -> None:
    """A profile's hierarchy beside its graph: nodes_ch_<profile> and shortcuts_<profile>. An arc whose ends have one level, or whose way leads over a higher node, is an error."""
    via = levels.select(F.col("node").alias("via"), F.col("level").alias("via_level"))
    checked = ch_arcs.join(via, "via", "left")
    wrong = (F.col("level") == F.col("level_adj")) | (F.col("via_level") >= F.least("level", "level_adj"))
    checked = checked.withColumn("weight", F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit("a shortcut against the order of levels")).cast("long")).otherwise(F.col("weight")))
    store({f"nodes_ch_{profile}": levels, f"shortcuts_{profile}": checked.select(ch_arcs.columns)}, f"{path}/ch_{profile}")


def load_hierarchy(spark: SparkSession, path: str, profile: str) -> tuple[DataFrame, DataFrame] | None:
    """(levels, ch_arcs), or None where they aren't stored whole, and have to be prepared again."""
    try:
        tables, _ = load(spark, f"{path}/ch_{profile}")
    except (PySparkException, ValueError, TypeError):
        return None
    return tables[f"nodes_ch_{profile}"], tables[f"shortcuts_{profile}"]
