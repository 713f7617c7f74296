"""Line dedup over a distributed suffix ranking of line-id sequences, with DataFrame functions only.

Lines get ids; a line that occurs once in the corpus ends every repeated run.
Prefix doubling ranks the suffixes of the id sequences by their first 1, 2, 4,
... lines: the ranks of two halves, as a pair, are sorted by range and numbered,
and pairs that occur once drop out. Suffixes of one rank form an interval whose
longest common prefix is at least the ranked length; an interval's first suffix
(by document id, then line) is the one that stays.

A repeated run counts if it has min_words words or more. All lines of such runs,
except where they occur first, are deleted. These are the lines covered by later
copies of windows that just reach min_words, from their first line on or up to
their last; a window of m lines is named by the ranks of its first and its last
2^k lines, 2^k <= m < 2^(k+1). So windows give exactly the union of all maximal
repeated runs, whatever their length.

A line or window that much of the corpus repeats is a hot key: it meets
aggregations with a map-side part, and joins that broadcast the few hot keys (see
common.looked_up). Frames of windows only grow, and overlapping copies are merged
before their lines are listed, so a document costs its length, not its square.

Cases: null texts stay null with no lines; an empty text is one blank line; blank
lines go only inside a repeated run. Rows of equal id and text are one document
and are treated alike; equal texts of other ids are copies. Null ids come first.
An empty table gives an empty result. Columns text and those named by results
are replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, looked_up, shuffle_parts, written

MIN_WORDS = 10


def ranked(groups: DataFrame, *by: str) -> DataFrame:
    """groups with rank: their place in the order of the columns by, without one task seeing all."""
    placed = written(groups.repartitionByRange(shuffle_parts(groups.sparkSession), *by).withColumn("·p", F.spark_partition_id()))
    before = Window.orderBy("·p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    starts = placed.groupBy("·p").count().select("·p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("·s"))
    inside = F.row_number().over(Window.partitionBy("·p").orderBy(*by))
    return placed.withColumn("·i", inside).join(F.broadcast(starts), "·p").withColumn("rank", F.col("·s") + F.col("·i")).drop("·p", "·i", "·s")


def line_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, t, pos, h1, h2, w): the lines of each distinct document; t tells texts of one id apart."""
    whole = F.col(f"`{text}`")
    # The hash and the lines come first: a text beside the generator would be copied once a line.
    cut = docs.filter(whole.isNotNull()).select(F.col(f"`{doc_id}`").alias("d"), F.xxhash64(whole).alias("t"), F.split(whole, "\n").alias("lines"))
    rows = cut.select("d", "t", F.posexplode("lines").alias("pos", "line"))
    words = F.size(F.filter(F.split("line", r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")
    return rows.select("d", "t", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), words.alias("w")).dropDuplicates(["d", "t", "pos"])


def windows_of(lines: DataFrame, min_words: int) -> DataFrame:
    """(d, t, pos, m): windows that just reach min_words, forward from each line and backward from each."""
    own = Window.partitionBy("d", "t")
    upto = lines.withColumn("after", F.sum("w").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    # Border b lies before line b; words before it: after - w. The last border of a document is its end.
    ends = upto.groupBy("d", "t").agg(F.max("pos").alias("pos"), F.sum("w").alias("words"))
    borders = upto.select("d", "t", "pos", (F.col("after") - F.col("w")).alias("words")).union(ends.select("d", "t", F.col("pos") + 1, "words"))
    # Both frames grow from their first row on, so each row is read once; the words left are minus the words before.
    reach = F.min("pos").over(own.orderBy("left").rangeBetween(Window.unboundedPreceding, -min_words))
    back = F.max("pos").over(own.orderBy("words").rangeBetween(Window.unboundedPreceding, -min_words))
    borders = borders.withColumn("left", -F.col("words"))
    near = borders.select("d", "t", "pos", reach.alias("reach"), back.alias("back"))
    ahead, behind = F.struct(F.col("pos"), (F.col("reach") - F.col("pos")).alias("m")), F.struct(F.col("back").alias("pos"), (F.col("pos") - F.col("back")).alias("m"))
    both = near.select("d", "t", F.explode(F.array(ahead, behind)).alias("x"))
    return both.select("d", "t", "x.pos", "x.m").filter("pos IS NOT NULL AND m > 0").distinct()


def deleted_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, pos, m): later copies of repeated windows, m lines from line pos on."""
    lines = written(line_table(docs, doc_id, text))
    twice = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
    names = written(looked_up(lines, ranked(twice, "h1", "h2"), ["h1", "h2"]).select("d", "t", "pos", "rank"))
    found, left, k = [], written(windows_of(lines, min_words)), 0
    dropped(lines)
    while True:
        length = 1 << k
        mine = left.filter((F.col("m") >= length) & (F.col("m") < 2 * length))
        head = names.select(F.col("d").alias("d2"), F.col("t").alias("t2"), F.col("pos").alias("p2"), F.col("rank").alias("r1"))
        tail = names.select(F.col("d").alias("d3"), F.col("t").alias("t3"), F.col("pos").alias("p3"), F.col("rank").alias("r2"))
        named = mine.join(head, F.expr("d <=> d2 AND t = t2 AND pos = p2")).drop("d2", "t2", "p2")
        named = named.join(tail, F.expr(f"d <=> d3 AND t = t3 AND pos + m - {length} = p3")).select("d", "t", "pos", "m", "r1", "r2")
        named = written(named)
        place = F.struct("d", "t", "pos")
        first = written(named.groupBy("m", "r1", "r2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"))
        later = looked_up(named, first, ["m", "r1", "r2"]).filter(~place.eqNullSafe(F.col("first")))
        found.append(written(later.select("d", "t", "pos", "m")))
        dropped(named)
        dropped(first)
        if not left.filter(F.col("m") >= 2 * length).limit(1).count():
            break
        ahead = names.select(F.col("d").alias("d2"), F.col("t").alias("t2"), (F.col("pos") - length).alias("p2"), F.col("rank").alias("r2"))
        pairs = written(names.join(ahead, F.expr("d <=> d2 AND t = t2 AND pos = p2")).select("d", "t", "pos", F.col("rank").alias("r1"), "r2"))
        again = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1")
        longer = written(looked_up(pairs, ranked(again, "r1", "r2"), ["r1", "r2"]).select("d", "t", "pos", "rank"))
        dropped(names)
        dropped(pairs)
        names = longer
        k += 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def merged(runs: DataFrame) -> DataFrame:
    """(d, t, pos, m): the runs with those that overlap or touch made one."""
    own = Window.partitionBy("d", "t").orderBy("pos", "m")
    ended = F.max(F.col("pos") + F.col("m")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("new", F.when(F.col("pos") <= ended, 0).otherwise(1))
    island = opened.withColumn("k", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("d", "t", "k").agg(F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("m")).alias("stop")).select("d", "t", "pos", (F.col("stop") - F.col("pos")).alias("m"))


RESULTS = ("n_lines", "n_deleted", "n_runs")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, results: tuple[str, str, str] = RESULTS) -> DataFrame:
    """docs with later copies of repeated line runs cut out of text, and its lines, deleted lines and maximal deleted runs, in columns named by results."""
    docs = docs.drop(*results)
    gone = merged(deleted_lines(docs, doc_id, text, min_words))
    by_doc = gone.groupBy(F.col("d").alias("·d"), F.col("t").alias("·t")).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("·runs"))
    names = [c for c in docs.columns if c != text]
    whole = F.col(f"`{text}`")
    joined = docs.withColumn("·h", F.xxhash64(whole)).join(by_doc, F.expr(f"`{doc_id}` <=> `·d` AND `·h` = `·t`"), "left")
    flat = joined.select(*[F.col(f"`{c}`") for c in names], whole.alias("·x"), F.split(whole, "\n").alias("·l"), F.coalesce("·runs", F.array().cast("array<struct<pos:int,m:int>>")).alias("·r"))
    # What stays lies between the runs: from the end of one, or line 0, to the start of the next, or the end.
    starts = F.concat(F.array(F.lit(0)), F.transform("·r", lambda r: r["pos"] + r["m"]))
    stops = F.concat(F.transform("·r", lambda r: r["pos"]), F.array(F.size("·l")))
    parts = F.zip_with(starts, stops, lambda a, z: F.slice("·l", a + 1, z - a))
    n_lines = F.when(F.col("·x").isNull(), 0).otherwise(F.size("·l")).cast("long")
    n_gone = F.aggregate("·r", F.lit(0).cast("long"), lambda a, r: a + r["m"])
    out = flat.select(*[F.col(f"`{c}`") for c in names], F.when(F.size("·r") == 0, F.col("·x")).otherwise(F.array_join(F.flatten(parts), "\n")).alias(text), n_lines.alias(results[0]), n_gone.alias(results[1]), F.size("·r").cast("long").alias(results[2]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *results)
