"""Fits the references of the quality rules on a bounded sample of documents with a language label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of
from .quality_rules import DIGIT, OTHER, PARAMETERS, PUNCTUATION, UPPER


def fitted(docs: DataFrame, lang: str = "lang", text: str = "text", documents: int = 2000, words: int = 20, seed: int = 11) -> dict[str, tuple[tuple, dict]]:
    """For each language: shares of the character classes without digits, and of its most frequent words.

    At most `documents` documents of a language are read: of those with min_words
    words or more, which a histogram needs, the ones of the smallest seeded hash.
    Nulls and languages without such a document have no reference. For the driver:
    one row a language.
    """
    body = F.col(f"`{text}`")
    long_ = docs.select(F.col(f"`{lang}`").alias("lang"), body.alias("text")).filter(F.col("lang").isNotNull() & (F.size(words_of(body)) >= PARAMETERS["min_words"]))
    first = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "text"), "text")
    sample = long_.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= documents).select("lang", "text")
    found = lambda pattern: F.sum(F.regexp_count("text", F.lit(pattern)))
    blank, rest, digit = found(r"[\x20\x09-\x0D]"), found(r"[^\x00-\x7F]"), found(DIGIT)
    classes = [found("[a-z]"), found(UPPER), blank, found(PUNCTUATION), found(OTHER), rest]
    shares = sample.groupBy("lang").agg((F.sum(F.char_length("text")) - digit).alias("all"), *[c.alias(f"c{k}") for k, c in enumerate(classes)])
    spoken = sample.select("lang", F.explode(words_of(F.col("text"))).alias("w")).select("lang", F.rtrim(F.lower("w"), F.lit(".,")).alias("w"))
    total = spoken.groupBy("lang").agg(F.count("*").alias("n"))
    common = spoken.groupBy("lang", "w").agg(F.count("*").alias("k")).groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "w"))), 1, words).alias("top"))
    out = {}
    for r in shares.join(total, "lang").join(common, "lang").collect():
        out[r.lang] = (tuple(round(r[f"c{k}"] / r["all"], 4) for k in range(6)), {x.w: round(-x.k / r.n, 4) for x in r.top})
    return out
