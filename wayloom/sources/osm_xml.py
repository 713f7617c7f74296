"""Map-element documents in XML as DataFrames of nodes, ways and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = "tag array<struct<_k:string,_v:string>>"
SCHEMAS = {
    "node": f"_id long, _lat double, _lon double, {TAG}",
    "way": f"_id long, nd array<struct<_ref:long>>, {TAG}",
    "relation": f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, {TAG}",
}


def read_elements(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Only the asked kind of element is read; negative ids are refused."""
    raw = spark.read.format("xml").option("rowTag", kind).schema(SCHEMAS[kind]).load(path)
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"])))
    own = {"node": ["_lat AS lat", "_lon AS lon"], "way": ["transform(coalesce(nd, array()), x -> x._ref) AS refs"], "relation": ["member AS members"]}[kind]
    checked = F.when(F.col("_id") >= 0, F.col("_id")).otherwise(F.raise_error(F.lit("negative ids aren't supported")).cast("long"))
    return raw.select(checked.alias({"node": "node", "way": "way", "relation": "relation"}[kind]), *[F.expr(e) for e in own], tags.alias("tags"))
