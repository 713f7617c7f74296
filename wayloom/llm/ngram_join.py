"""Near-duplicate join on 5-word shingles by token-combination prefixes.

Documents with equal shingle sets are one node from the start, however many
they are. The join then runs in these steps, each a table of bounded groups:

1. Shingles are hashed and scattered by hash range; a range counts the nodes of
   each shingle. A shingle of one node can't be shared and only its number stays.
   Where there are more than SPLIT nodes, each range is also split by node, and
   the parts' counts are summed, so that a hot shingle has no task to itself.
2. A node orders its shingles from rare to frequent. Sets with a Jaccard
   similarity of 3/4 share a shingle in prefixes of n - ceil(3n/4) + 1, and
   c + 1 shingles in prefixes extended by c. Rare shingles of the extended prefix
   are indexed singly. Frequent ones fall into c classes by hash; two of c + 1
   shared ones fall into the same class, so pairs (2-token combinations) within
   a class are indexed. c grows with the set, in steps of size; a node is indexed
   under its step and the next one, as similar sets differ by one step at most.
3. All nodes with an index key are verified against the key's first node, then,
   where a key's nodes aren't connected yet, against other nodes chosen by hash,
   while that leaves a tenth less. What is left is compared exactly, block by block of
   the nodes that keys join. So
   each candidate pair is either verified or inside one component already, and a
   group of near copies costs its size, not its square.

Prefixes, order and verification use 48-bit fingerprints of 64-bit shingle
hashes; a node is a 64-bit hash of its set.

Ids may be of any type that can be ordered.

Cases: null, empty and blank texts have no shingles and link with nothing, fewer
words than a window are one shingle; rows with null or repeated ids get their
node's component, null being the smallest id; an empty table gives an empty
result. Other columns aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, dropped, looked_up, released, written
from .components import components

WINDOW = 5
FINGERPRINT = (1 << 48) - 1
RARE = 24  # a df class (4 log2) below this, that is fewer than 64 nodes, is indexed singly
TURNS = 4  # rounds with other first nodes, at most; they only save work, the last step is exact
BLOCK, NODES = 400_000, 2048  # fingerprints and nodes of a block in the last step
DENSE, CELLS = 256, 500_000  # a mark of this part of a block's pairs or more is a matrix column; pairs counted at a time
LINKS = 1 << 19  # whose components one task finds, in about 60 MB
SPLIT = 24_000_000  # documents of whose nodes a task may have to hold a shingle's list
RANGE_BYTES = 10_000_000  # of text to a hash range, in prose 1.5 million shingles
BATCH = 1 << 20  # shingles scattered at a time
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
BLANKS = re.compile("[\x20\x09-\x0d]+")
ODD_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of a sorted array."""
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


class Shingler:
    def __init__(self, keep: int = 300_000):
        self.of = Memo(lambda w: xxhash.xxh64_intdigest(w), keep)

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        # ASCII letters only; str.split knows more blanks than the definition does
        text = text.lower() if text.isascii() else text.translate(LOWER)
        return [w for w in BLANKS.split(text) if w] if ODD.search(text) else text.split()

    def __call__(self, text: str | None) -> np.ndarray:
        """The distinct shingle hashes of a text, sorted."""
        words = self.words(text)
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = np.fromiter(map(self.of.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(WINDOW, len(h))
        sums = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            sums += h[i : len(h) - k + 1 + i] * ODD_MULTIPLIERS[i]
        return distinct(np.sort(mixed(sums)))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else 0


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    return distinct(shingles >> np.uint64(16))


def step_of(n):
    """Sizes in steps by a factor of 4/3: similar sets are at most one step apart."""
    return np.floor(np.log(n) / np.log(4 / 3) + 1e-9).astype(np.int64)


def classes_of(step):
    return np.maximum(1, ((4 / 3) ** np.asarray(step) / 8).astype(np.int64))


def index_keys(n: int, u: int, tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Keys of a node of n shingles, u of them its own alone; the shared ones come from rare to frequent."""
    step = int(step_of(n))
    prefix = n - -(-3 * n // 4) + 1
    wide = min(len(tokens), max(0, prefix + int(classes_of(step + 1)) - u))
    keys = [mixed(tokens[:wide][classes[:wide] < RARE])]
    for s in (step, step + 1):
        c = int(classes_of(s))
        reach = min(len(tokens), max(0, prefix + c - u))
        often = tokens[:reach][classes[:reach] >= RARE]
        if len(often) > 1:
            cls = (mixed(often) % np.uint64(c)).astype(np.int64)
            order = np.argsort(cls, kind="stable")
            often, cls = often[order], cls[order]
            for gap in range(1, len(often)):
                same = cls[gap:] == cls[:-gap]
                if not same.any():
                    break
                a, b = often[:-gap][same], often[gap:][same]
                keys.append(mixed(mixed(np.minimum(a, b)) * np.uint64(31) + np.maximum(a, b) + np.uint64(s << 50)))
    return np.unique(np.concatenate(keys))


def passed_once(docs: DataFrame, doc_id: str, text: str, ranges: int, splits: int) -> DataFrame:
    """What the join takes from the texts, which are read and shingled here alone.

    Rows of MARKS. part is range * splits + node % splits for nodes, counts and
    marks: the fingerprints of some nodes that lie in a hash range, as 6 bytes each.
    own and sizes are nodes whose home the part's range is, and their numbers of
    fingerprints. docs has a row for each document, and lies in any part.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def emit(held: dict):
        nodes = np.array(list(held), dtype=np.int64)
        lengths = np.array([len(s) for s in held.values()])
        marks = np.concatenate(list(held.values()))
        owner = np.repeat(np.arange(len(nodes), dtype=np.int32), lengths)
        part = ((marks >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        if splits > 1:
            part = part * splits + (nodes % splits)[owner]
        order = np.argsort(part.astype(np.uint16) if ranges * splits < 1 << 16 else part, kind="stable")  # owners ascend already
        part, owner, marks = part[order], owner[order], marks[order]
        start = np.nonzero(np.append(True, (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])))[0]  # of a node in a part
        counts, packed = np.diff(start, append=len(part)).astype("<u4"), six_bytes(marks)
        steps = np.arange(ranges * splits + 1)
        at, pairs = np.searchsorted(part, steps), np.searchsorted(part[start], steps)
        nodes_in = nodes[owner[start]]
        home = (nodes.astype(np.uint64) % np.uint64(ranges)).astype(np.int64) * splits
        order = np.argsort(home, kind="stable")
        homes, own, sizes = np.searchsorted(home[order], steps), nodes[order], lengths[order].astype("<u4")
        out = []
        for r in np.nonzero(np.diff(at) + np.diff(homes))[0].tolist():
            here, mine = slice(pairs[r], pairs[r + 1]), slice(homes[r], homes[r + 1])
            out.append((r, nodes_in[here].tobytes(), counts[here].tobytes(), packed[at[r] : at[r + 1]].tobytes(), own[mine].tobytes(), sizes[mine].tobytes()))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)]
        return columns, len(out)

    def run(frames):
        shingles, held, n = Shingler(), {}, 0
        for k, frame in enumerate(frames):
            ids, found = frame.column(0), []
            entry = pa.struct([("doc", ids.type), ("n_shingles", pa.int64()), ("n_marks", pa.int64()), ("node", pa.int64())])
            names = ["part", "nodes", "counts", "marks", "own", "sizes", "docs"]

            def row(columns, many, entry=entry, names=names):
                return pa.RecordBatch.from_arrays([*columns, pa.nulls(many, pa.list_(entry))], names=names)

            for t in frame.column(1).to_pylist():
                s = shingles(t)
                node, marks = node_of(s), fingerprints(s)
                found.append((len(s), len(marks), node))
                if len(s) and node not in held:
                    held[node] = marks
                    n += len(s)
                    if n >= BATCH:
                        yield row(*emit(held))
                        held, n = {}, 0
            if found:
                all_docs = pa.StructArray.from_arrays([ids, *[pa.array(c, pa.int64()) for c in zip(*found, strict=True)]], fields=list(entry))
                lists = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), all_docs)
                yield pa.RecordBatch.from_arrays([pa.array([(found[0][2] + k) % (ranges * splits)], pa.int32()), *[pa.array([b""], pa.binary())] * 5, lists], names=names)
        if held:
            yield row(*emit(held))

    return docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"part int, nodes binary, counts binary, marks binary, own binary, sizes binary, docs {entry_of(kind)}")


def entry_of(kind: str) -> str:
    return f"array<struct<doc: {kind}, n_shingles: bigint, n_marks: bigint, node: bigint>>"


def six_bytes(marks: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(marks.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :6])


def joined(table: pa.Table, column: str, kind) -> np.ndarray:
    """The values of a column of packed arrays, one after the other."""
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype=kind)


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, counts, marks): the nodes' marks follow each other."""
    packed = joined(table, "marks", np.uint8).reshape(-1, 6)
    marks = np.zeros((len(packed), 8), dtype=np.uint8)
    marks[:, :6] = packed
    return joined(table, "nodes", np.int64), joined(table, "counts", "<u4"), marks.view("<u8").reshape(-1).astype(np.uint64, copy=False)


def distinct_entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """unpacked, each node once: a copy in another batch isn't another node, and has the same marks."""
    nodes, counts, marks = unpacked(table)
    first = np.unique(nodes, return_index=True)[1]
    if len(first) < len(nodes):
        new = np.zeros(len(nodes), dtype=bool)
        new[first] = True
        marks = marks[np.repeat(new, counts)]
        nodes, counts = nodes[new], counts[new]
    return nodes, counts, marks


def class_of(df: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.floor(4 * np.log2(np.maximum(df, 1)))).astype(np.uint8)


def numbered(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and how often each is there."""
    marks = np.sort(marks)
    start = np.nonzero(np.append(True, marks[1:] != marks[:-1])[: len(marks)])[0]
    return marks[start], np.diff(start, append=len(marks))


def dealt_home(table: pa.Table, entries, known: np.ndarray, df: np.ndarray, ranges: int, splits: int) -> pa.Table:
    """Rows of SHARED: the entries whose marks are known, with classes of df, part being a hash of the node; and the rest of the table's columns."""
    nodes, counts, marks = entries
    # Most marks aren't known, and their hashes' last bits tell so at once.
    bits = np.uint64((1 << 22) - 1)
    seen = np.zeros(1 << 22, dtype=bool)
    seen[(known & bits).astype(np.int64)] = True
    place = np.nonzero(seen[(marks & bits).astype(np.int64)])[0]
    at = np.searchsorted(known, marks[place]) if len(known) else place
    hit = known[np.minimum(at, len(known) - 1)] == marks[place] if len(known) else np.zeros(len(place), dtype=bool)
    place, cls = place[hit], class_of(df)[at[hit]]
    ends = np.cumsum(counts, dtype=np.int64)
    counts = np.diff(np.searchsorted(place, ends), prepend=0)
    marks = marks[place]
    some = counts > 0
    nodes, counts = nodes[some], counts[some]
    home = (nodes.astype(np.uint64) % np.uint64(ranges)).astype(np.int64)
    order = np.lexsort((nodes, home))
    start = (np.cumsum(counts) - counts)[order]
    home, nodes, counts = home[order], nodes[order], counts[order]
    stop = np.cumsum(counts)
    take = np.repeat(start - (stop - counts), counts) + np.arange(len(marks))
    packed, cls, sizes = six_bytes(marks[take]), cls[take], counts.astype("<u4")
    at = np.searchsorted(home, np.arange(ranges + 1))
    edge = np.append(0, stop)[at]
    out = []
    for r in np.nonzero(np.diff(at))[0].tolist():
        here, those = slice(at[r], at[r + 1]), slice(edge[r], edge[r + 1])
        out.append((r, nodes[here].tobytes(), sizes[here].tobytes(), packed[those].tobytes(), cls[those].tobytes(), b"", b""))
    out.append((table.column("part")[0].as_py() // splits, b"", b"", b"", b"", *[b"".join(table.column(c).to_pylist()) for c in ("own", "sizes")]))
    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 6), strict=True)]
    names = ["part", "nodes", "counts", "marks", "classes", "own", "sizes"]
    found = pa.table([*columns, pa.nulls(len(out), table.schema.field("docs").type)], names=names + ["docs"])
    docs = table.filter(pa.compute.is_valid(table.column("docs")))
    if not docs.num_rows:
        return found
    empty = pa.array([b""] * docs.num_rows, pa.binary())
    return pa.concat_tables([found, pa.table([pa.array([out[-1][0]] * docs.num_rows, pa.int32()), *[empty] * 6, docs.column("docs")], names=found.column_names)])


def shared_in_range(table: pa.Table, ranges: int) -> pa.Table:
    """Rows of SHARED from the rows of a hash range."""
    entries = distinct_entries(table)
    marks, df = numbered(entries[2])
    return dealt_home(table, entries, marks[df > 1], df[df > 1], ranges, 1)


def shared_marks(parts: DataFrame, ranges: int, splits: int) -> DataFrame:
    """Rows of SHARED, part now a hash of the nodes: the fingerprints that several nodes have, with classes of their number."""
    schema = f"part int, nodes binary, counts binary, marks binary, classes binary, own binary, sizes binary, docs {parts.schema['docs'].dataType.simpleString()}"
    if splits > 1:
        return shared_by_counts(written(parts), schema, ranges, splits)

    def run(table: pa.Table) -> pa.Table:
        return shared_in_range(table, ranges)

    return parts.groupBy("part").applyInArrow(run, schema)


def shared_by_counts(parts: DataFrame, schema: str, ranges: int, splits: int) -> DataFrame:
    """shared_marks where each range is split by node: the parts' counts are summed and go back to the parts."""

    def count(table: pa.Table) -> pa.Table:
        mark, df = numbered(distinct_entries(table)[2])
        part = table.column("part")[0].as_py()
        return pa.table({"range": pa.array([part // splits], pa.int32()), "marks": pa.array([mark.tobytes()], pa.binary()), "df": pa.array([df.astype("<i8").tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        mark, back = np.unique(joined(table, "marks", "<u8"), return_inverse=True)
        df = np.bincount(back, weights=joined(table, "df", "<i8"), minlength=len(mark)).astype("<i8")
        return pa.table({"range": table.column("range")[:1], "marks": pa.array([mark[df > 1].tobytes()], pa.binary()), "df": pa.array([df[df > 1].tobytes()], pa.binary())})

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # a part that no row was dealt to
            return pa.table({k: pa.array([], t) for k, t in zip(names, kinds, strict=True)})
        return dealt_home(left, distinct_entries(left), joined(right, "marks", "<u8"), joined(right, "df", "<i8"), ranges, splits)

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["part", "nodes", "counts", "marks", "classes", "own", "sizes", "docs"]
    kinds = [pa.int32(), *[pa.binary()] * 6, to_arrow_type(parts.schema["docs"].dataType)]
    kept = "range int, marks binary, df binary"
    sums = parts.drop("own", "sizes", "docs").groupBy("part").applyInArrow(count, kept).groupBy("range").applyInArrow(add, kept)
    back = sums.withColumn("part", F.explode(F.sequence(F.col("range") * splits, F.col("range") * splits + splits - 1)))
    return parts.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(keep, schema)


def indexed(shared: DataFrame) -> DataFrame:
    """(node, n, marks, keys) of each node whose extended prefix holds a shared shingle, and rows of docs."""

    def run(table: pa.Table) -> pa.Table:
        nodes, counts, mark = unpacked(table)
        node = np.repeat(nodes, counts)
        cls = joined(table, "classes", np.uint8)
        order = np.lexsort((mark, cls, node))
        node, mark, cls = node[order], mark[order], cls[order]
        nodes, at = np.unique(node, return_index=True)
        at = np.append(at, len(node))
        own, place = np.unique(joined(table, "own", np.int64), return_index=True)
        n_marks = joined(table, "sizes", "<u4")[place][np.searchsorted(own, nodes)]
        out = []
        for k, (v, n) in enumerate(zip(nodes.tolist(), n_marks.tolist(), strict=True)):
            lo, hi = at[k], at[k + 1]
            keys = index_keys(n, n - (hi - lo), mark[lo:hi], cls[lo:hi])
            if len(keys):
                out.append((v, n, mark[lo:hi].view(np.int64), keys.view(np.int64)))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = ["node", "n", "marks", "keys"]
        docs = pa.compute.drop_null(table.column("docs"))
        return pa.table([*[pa.concat_arrays([pa.array(c, t), pa.nulls(len(docs), t)]) for c, t in zip(columns, kinds, strict=True)], pa.chunked_array([pa.nulls(len(out), docs.type), *docs.chunks])], names=names + ["docs"])

    return shared.groupBy("part").applyInArrow(run, f"node long, n long, marks array<long>, keys array<long>, docs {shared.schema['docs'].dataType.simpleString()}")


def prepared(docs: DataFrame, doc_id: str, text: str, split: int) -> tuple[DataFrame, DataFrame]:
    """(doc, n_shingles, n_marks, node) of each document, and the nodes of indexed()."""
    spark = docs.sparkSession
    size, rows = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long")), F.count("*")).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, 4, -(-(size or 0) // RANGE_BYTES))
    splits = max(1, -(-rows // split))
    both = written(indexed(shared_marks(passed_once(docs, doc_id, text, ranges, splits), ranges, splits)))
    released(spark)
    return both.filter("docs IS NOT NULL").select(F.inline("docs")), both.filter("node IS NOT NULL").drop("docs")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity is 3/4 or more."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("marks").alias("ma"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("mb"))
    near = pairs.join(a.select("a", "na"), "a").join(b, "b").filter((4 * F.col("na") >= 3 * F.col("nb")) & (4 * F.col("nb") >= 3 * F.col("na")))
    both = near.join(a.select("a", "ma"), "a").withColumn("o", F.size(F.array_intersect("ma", "mb")))
    return both.filter(100 * F.col("o") >= 75 * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def similar_nodes(sets: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have links."""
    spark = sets.sparkSession
    entries = written(sets.select("node", F.explode("keys").alias("key")))
    first = written(entries.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("n")).filter("a < z").drop("z"))
    pairs = written(looked_up(entries, first, ["key"]).filter("node != a").select("a", F.col("node").alias("b")).distinct())
    dropped(first)
    links = written(verified(pairs, sets))
    roots = components(links, LINKS)
    # Only keys that lie in several components matter from here on.
    left = written(_in_several(entries, roots))
    rows = left.count()
    if not rows:
        return roots
    for turn in range(1, TURNS):
        leader = left.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.pmod("key", F.lit(3)), F.lit(turn)).alias("h"), "node", "root")).alias("x"), F.count("*").alias("n"))
        met = looked_up(left, leader, ["key"]).filter(F.col("root") != F.col("x.root")).select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).distinct()
        met = written(met.join(pairs, ["a", "b"], "left_anti"))
        new = written(verified(met, sets))
        if not new.limit(1).count():
            break
        pairs, links = pairs.union(met), links.union(new)
        roots = components(links, LINKS)
        left = written(_in_several(left.select("node", "key"), roots))
        before, rows = rows, left.count()
        if 10 * rows > 9 * before:
            break
    more = written(compared(left, sets))
    released(spark)
    return components(links.union(more), LINKS) if more.limit(1).count() else roots


def overlaps(owner: np.ndarray, marks: np.ndarray, side: list[np.ndarray]) -> np.ndarray:
    """The number of common marks of each owner in side[0] and each in side[1]; where these are the same, an owner's with itself may be too small.

    Marks of many owners are multiplied as columns of a matrix, the pairs of the
    others are counted one by one, and a mark that isn't in two owners costs nothing.
    """
    tokens, index = np.unique(marks, return_inverse=True)
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    most = int(owner.max(initial=-1)) + 1
    held, rows, start, count = [], [], [], []
    for own in side:
        place = np.full(max(most, int(own.max(initial=-1)) + 1), -1)
        place[own] = np.arange(len(own))
        mine = place[owner]
        held.append(index[mine >= 0])
        rows.append(mine[mine >= 0])
        count.append(np.bincount(held[-1], minlength=len(tokens)))
        start.append(np.cumsum(count[-1]) - count[-1])
    shape = len(side[0]), len(side[1])
    both = np.zeros(shape, dtype=np.float32)
    cells = count[0] * count[1]
    often = cells > shape[0] * shape[1] // DENSE
    few = np.nonzero((cells > (side[0] is side[1])) & ~often)[0]
    total = np.cumsum(cells[few])
    lo = 0
    while lo < len(few):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + CELLS, side="right")))
        t = few[lo:hi]
        rep = np.repeat(t, cells[t])
        off = np.arange(len(rep)) - np.repeat(total[lo:hi] - cells[t] - done, cells[t])
        x, y = np.divmod(off, count[1][rep])
        np.add.at(both.reshape(-1), rows[0][start[0][rep] + x] * shape[1] + rows[1][start[1][rep] + y], np.float32(1))
        lo = hi
    columns = np.cumsum(often) - 1
    for lo in range(0, int(often.sum()), 1024):
        part = []
        for k in (0, 1):
            at = columns[held[k]] - lo
            here = often[held[k]] & (at >= 0) & (at < 1024)
            m = np.zeros((shape[k], 1024), dtype=np.float32)
            m[rows[k][here], at[here]] = 1
            part.append(m)
        both += part[0] @ part[1].T
    return both


def compared(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components, from the exact comparison of all nodes that are left and joined by keys.

    Nodes joined by keys are a cluster; a cluster is cut by hash into blocks of
    about BLOCK fingerprints and NODES nodes at most, and each two blocks are
    compared in a task of their own, of bounded size, which gives one link for
    each two components it joins. The work grows with the square of a cluster.
    """
    first = left.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n"))
    clusters = components(written(looked_up(left, first, ["key"]).select("a", F.col("node").alias("b")).distinct()), LINKS)
    nodes = left.select("node", "root").distinct().join(clusters.withColumnRenamed("root", "cluster"), "node").join(sets.select("node", "n", "marks"), "node")
    size = left.select("node").distinct().join(clusters.withColumnRenamed("root", "cluster"), "node").join(sets.select("node", "n"), "node").groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / NODES)).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = nodes.join(size, "cluster").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = dealt.select("cluster", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("high"), "node", "root", "n", "marks")

    def run(table: pa.Table) -> pa.Table:
        high = table.column("high").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        side = [np.nonzero(~high)[0], np.nonzero(high)[0]] if hi != lo else [np.arange(len(high))] * 2
        node, root, n = (table.column(c).to_numpy() for c in ("node", "root", "n"))
        lists = table.column("marks").combine_chunks()
        ends = lists.offsets.to_numpy()
        owner = np.repeat(np.arange(len(high)), np.diff(ends))
        both = overlaps(owner, lists.values.to_numpy()[ends[0] : ends[-1]], side)
        na, nb = n[side[0]][:, None], n[side[1]][None, :]
        hit = (100 * both >= 75 * (na + nb - both)) & (root[side[0]][:, None] != root[side[1]][None, :])
        found = {}
        for i, j in zip(*np.nonzero(hit), strict=True):
            x, y = side[0][i], side[1][j]
            found.setdefault((min(root[x], root[y]), max(root[x], root[y])), (node[x], node[y]))
        return pa.table({"a": pa.array([int(v[0]) for v in found.values()], pa.int64()), "b": pa.array([int(v[1]) for v in found.values()], pa.int64())})

    return pairs.groupBy("cluster", "lo", "hi").applyInArrow(run, "a long, b long")


def _in_several(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root) of the keys whose nodes lie in several components."""
    placed = entries.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("key", "n")
    return looked_up(placed, apart, ["key"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", split: int = SPLIT) -> DataFrame:
    """(doc, n_shingles, component) of each row of docs; component: the smallest id reachable by links."""
    nodes, sets = prepared(docs, doc_id, text, split)
    roots = similar_nodes(sets)
    rooted = nodes.groupBy("node").agg(F.min("doc").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = rooted.join(least, "root").select("node", "component")
    with_words = nodes.filter("n_shingles > 0").join(classes, "node").select("doc", "n_shingles", "component")
    return with_words.union(nodes.filter("n_shingles = 0").select("doc", "n_shingles", F.col("doc").alias("component")))


__all__ = ["near_duplicates"]
