"""Exact Jaccard join of documents by their 5-word shingles, and its components.

The Jaccard distance is a metric. Documents that share no shingle are at
distance 1 from each other and from nearly every pivot, so pivots drawn at
random put all documents at one distance and window them into every region.
Regions here are therefore those around shingles of low hash: two sets with a
similarity of 0.8 share shingles among their lowest hashes (`lowest`), so
every link lies inside at least one region. Then

* a region of at most SMALL documents is joined whole, and a pair goes on only
  if it shares as many low hashes as a link must and its sizes allow one;
* documents with more than a few used hashes in larger regions (`is_dense`)
  are joined again among themselves around all their hashes: any two linked
  ones share four fifths of them, so a document with fewer in larger regions
  (`is_common`) meets all its partners in small ones;
* what is left, such as large groups of near copies, is joined around pivots:
  each region's members are measured against its pivots, members within the
  radius are linked, a pair is left out where the triangle inequality through
  one of the first pivots rules it out, and the region is joined again with four
  times the pivots until all of it is one component or each pair has been decided.

Each measured pair is compared on whole sets. Equal sets are one class from
the start. Components come from alternating star contractions.

Defined results: null and empty texts, and those without a word, have an empty
set and stand alone; texts of fewer than five words are one shingle; doc_id
names a document: rows with the same id and different texts are one component;
a null doc_id is no one's smallest id; an empty table gives an empty result;
other columns are not read. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lean, materialise

SHINGLE = 5
#: Documents of a region that is joined whole.
SMALL = 8
#: First regions of a document that tell whether a pair has come up before.
HEAD = 8
#: Pivots of a large region in its first round.
FIRST_PIVOTS = 8
#: Pivots of the first round through which the triangle inequality is applied.
FAR = 3
#: Low hashes that a reducing task takes, about.
TASK_HASHES = 1_500_000
#: Low hashes that it sorts at a time, about; and those that a task before it sorts and packs at a time.
PART_HASHES, BLOCK_HASHES = 150_000, 500_000
#: Ids in a broadcast at most; beyond it, joins shuffle.
BROADCAST_IDS = 300_000
#: Stands for a null doc_id, above every other.
NO_ID = 2**63 - 1


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(SHINGLE, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def lowest(n: int) -> int:
    """How many lowest hashes of a set of n are used.

    If J(x, y) >= 0.8 then x lacks at most n // 5 of its elements in y. The set
    whose used hashes end lower has all but those in the other's used ones, so
    the two share 1 + min(n_x // 10, n_y // 10) of them at least.
    """
    return min(n, n // 5 + 1 + n // 10)


def is_dense(n: Column, large: Column) -> Column:
    """Whether a set of n with `large` used hashes in large regions may have partners there only.

    Otherwise: 2 * n // 25 <= n_y // 10 for every n_y >= 0.8 n, so any partner shares
    a hash of a small region with it.
    """
    return large > F.floor(2 * n / 25)


def is_common(n: Column, large: Column) -> Column:
    """The same where all hashes are used: linked sets share ceil(0.8 n) of n at least."""
    return 10 * large >= 8 * n


def enough(n_a: str, n_b: str) -> Column:
    """The least intersection of linked sets of these sizes: J >= 0.8 is 9 * shared >= 4 * (n_a + n_b)."""
    return F.floor((4 * (F.col(n_a) + F.col(n_b)) + 8) / 9)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            n, mark = [], []
            for text in part.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                mark.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(mark, pa.binary())], ["doc_id", "n", "mark"]
            )


def _postings(buckets: int):
    """Packed (hash, document, size) by bucket of the hash: the used hashes of texts, or all of given sets.

    A hash of more than SMALL documents here makes a large region, whatever other
    tasks have: its postings go to bucket -1, which is not shuffled, and one
    posting of node -1 tells its bucket. So a bucket gets at most SMALL + 1
    postings of a hash from each block, however many documents share it.
    """

    def pack(keys: list, nodes: list, sizes: list) -> pa.RecordBatch:
        # One array for each document until here; documents in order of their ids, so that a stable sort by hash will do.
        by = np.argsort(np.array(nodes, np.int64), kind="stable")
        many = np.array([len(k) for k in keys], np.int64)[by]
        key = np.concatenate([keys[i] for i in by])
        keys.clear()
        which = np.repeat(np.arange(len(by), dtype=np.int32), many)
        order = np.argsort(key, kind="stable")
        key, which = key[order], which[order]
        del order
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.append(start, len(key)))
        marks = key[start[many > SMALL]]
        own = (key % np.uint64(buckets)).astype(np.int32) + 1
        own[np.repeat(many > SMALL, many)] = 0
        own = np.concatenate([own, (marks % np.uint64(buckets)).astype(np.int32) + 1])
        # Document -1, of size 0, marks a hash of many.
        which = np.concatenate([which, np.full(len(marks), len(by), np.int32)])
        key = np.concatenate([key, marks])
        nodes, sizes = np.append(np.array(nodes, np.int64)[by], -1), np.append(np.array(sizes, np.int32)[by], np.int32(0))
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own, np.arange(buckets + 2), sorter=order)
        del own
        rows = []
        for b in np.flatnonzero(np.diff(cuts)):
            i = order[cuts[b] : cuts[b + 1]]
            k, w = key[i], which[i]
            rows.append(
                (
                    int(b) - 1,
                    (k & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                    (k >> np.uint64(32)).astype("<u2").tobytes(),
                    np.diff(nodes[w], prepend=0).astype("<i8").tobytes(),
                    sizes[w].astype("<i4").tobytes(),
                )
            )
        kinds = [pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "low", "high", "node", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, sizes, held = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = pa.types.is_string(part.column(1).type)
                each = part.column(1).to_pylist() if texts else [x.values.to_numpy() for x in part.column(1)]
                for node, item in zip(part.column(0).to_pylist(), each):
                    s = shingles(item) if texts else item.view(np.uint64)
                    if len(s):
                        used = s[: lowest(len(s)) if texts else len(s)] >> np.uint64(16)
                        keys.append(used)
                        nodes.append(node)
                        sizes.append(len(s))
                        held += len(used)
                    if held >= BLOCK_HASHES:
                        yield pack(keys, nodes, sizes)
                        keys, nodes, sizes, held = [], [], [], 0
        if held:
            yield pack(keys, nodes, sizes)

    return run


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """low, high, node and size of the postings of each row, as they are stored but for the nodes' differences."""
    for low, high, node, size in zip(*[batch.column(c) for c in range(1, 5)]):
        whole = (np.frombuffer(x.as_buffer(), t) for x, t in ((low, "<u4"), (high, "<u2"), (node, "<i8"), (size, "<i4")))
        low, high, node, size = whole
        yield low, high, np.cumsum(node), size


def _key(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) | (high.astype(np.int64) << 32)


def _rows(kind: int, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(a), 65536):
        cut = slice(at, at + 65536)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(a[cut]), kind, np.int32)),
                pa.array(a[cut]),
                pa.array(b[cut]),
                pa.array(n_a[cut].astype(np.int64)),
                pa.array(n_b[cut].astype(np.int64)),
            ],
            ["kind", "a", "b", "n_a", "n_b"],
        )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1 from bucket -1."""
    for batch in batches:
        for low, high, node, size in _columns(batch):
            yield from _rows(1, node, _key(low, high), size, size)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0: pair a, b of a small region; kind 1: member a of the large region b), with sizes."""
    held: list[list[np.ndarray]] = [[], [], [], []]
    for batch in batches:
        for columns in _columns(batch):
            for own, column in zip(held, columns):
                own.append(column.copy())
    if not held[0]:
        return
    whole = []
    for own in held:
        whole.append(np.concatenate(own))
        own.clear()
    # Sorted in parts of the hashes, since sorting takes several times what is held.
    parts = -(-len(whole[0]) // PART_HASHES)
    for part in range(parts):
        here = np.flatnonzero(whole[1] % parts == part)
        low, high, node, size = (c[here] for c in whole)
        yield from _joined_regions(_key(low, high), node, size)


def _joined_regions(key: np.ndarray, node: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of _regions for all postings of some hashes."""
    if not len(key):
        return
    order = np.lexsort((node, key))
    key, node, size = key[order], node[order], size[order]
    # Rows of one id with different texts may repeat a hash: the region has it once.
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
    key, node, size = key[once], node[once], size[once]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(start, len(key)))
    # A node of -1 stands first among its hash's and says that the region is large.
    count = np.where(node[start] < 0, SMALL + 1, count)
    large = np.repeat(count > SMALL, np.diff(np.append(start, len(key)))) & (node >= 0)
    yield from _rows(1, node[large], key[large], size[large], size[large])
    for c in range(2, SMALL + 1):
        first = start[count == c]
        for i in range(c):
            for j in range(i + 1, c):
                n_a, n_b = size[first + i].astype(np.int64), size[first + j].astype(np.int64)
                fits = 5 * np.minimum(n_a, n_b) >= 4 * np.maximum(n_a, n_b)
                yield from _rows(0, node[first + i][fits], node[first + j][fits], n_a[fits], n_b[fits])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingles(t).view(np.int64) for t in part.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["node", "hashes"]
            )


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the ids; they are broadcast only if they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows of these ids; rows of a null id stay."""
    return _only(docs, ids, "left_anti")


def measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, shared, joint: sizes of intersection and union of each pair's whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (
        pairs.select("a", "b")
        .join(left, "a")
        .join(right, "b")
        .select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("joint"))
    )


def linked() -> Column:
    return 100 * F.col("shared") >= 80 * F.col("joint")


def connected(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node of each component, by alternating large and small stars."""
    spark = edges.sparkSession
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.col("v") % 1_000_003)).first()
        if mark == before or not mark[0]:
            break
        before = mark
        # Large star: each node joins its larger neighbours to the least of all its neighbours and itself.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: each node joins its smaller neighbours and itself to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = materialise(small.select("e.u", "e.v").filter("u <> v").distinct(), "stars")
    out = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return spark.createDataFrame([], out.schema) if before is None else out.unionByName(tops)


def joined(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Components with more links: only the links between components are contracted anew."""
    left, right = (comp.select(F.col("node").alias(k), F.col("comp").alias(f"c_{k}")) for k in ("a", "b"))
    named = edges.join(left, "a", "left").join(right, "b", "left")
    ends = named.select("a", "b", F.coalesce("c_a", "a").alias("x"), F.coalesce("c_b", "b").alias("y"))
    ends = materialise(ends.filter("x <> y"), "joining")
    tops = connected(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    tops = tops.select(F.col("node").alias("t"), F.col("comp").alias("top"))
    nodes = comp.unionByName(ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("comp")), F.struct(F.col("b").alias("node"), F.col("y").alias("comp")))).alias("e")).select("e.*")).distinct()
    return materialise(nodes.join(tops, F.col("comp") == F.col("t"), "left").select("node", F.coalesce("top", "comp").alias("comp")), "components")


def _prefixes(member: DataFrame) -> DataFrame:
    """region, node, n, large, head, far: each document in the first of its large regions only.

    Two that must share ceil(0.8 n) of n hashes in large regions share one of the
    first large - ceil(0.8 n) + 1 of each. head: the first HEAD of these.
    """
    own = member.groupBy("node", "n", "large").agg(F.array_sort(F.collect_set("region")).alias("all"))
    own = own.withColumn("all", F.slice("all", F.lit(1), (F.col("large") - F.ceil(F.col("n") * 8 / 10 - 1e-9) + 1).cast("int")))
    return own.select(
        F.explode("all").alias("region"), "node", "n", "large", F.slice("all", 1, HEAD).alias("head"), F.lit(None).cast("array<double>").alias("far")
    )


def _pivot_rounds(members: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """node, comp with the links among the members (region, node, n, large) of large regions added to those known.

    A pair that shares a hash of a small region has been decided there; all that
    any other pair shares lies in large regions, of which a document has `large`.
    """
    number = done = 0
    comp = connected(links)
    while True:
        state = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        # Regions of more than one component; one whose members have all been pivots is decided.
        left = state.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"))
        left = left.filter(F.col("lo") != F.col("hi")).filter(F.col("m") > done)
        state = state.join(left.select("region"), "region")
        state = materialise(state, "regions")
        if state.isEmpty():
            return comp
        # The next pivots in an order that all regions share, so that they choose alike: 8, 32, 128, ...
        more = FIRST_PIVOTS * 4**number
        order = Window.partitionBy("region").orderBy(F.xxhash64("node"), "node")
        pivots = state.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= done + more)
        pivots = pivots.filter(F.col("nth") > done).select(
            "region", F.col("node").alias("p"), F.col("n").alias("n_p"), F.col("large").alias("large_p"),
            F.col("comp").alias("comp_p"), F.col("far").alias("far_p"), F.col("head").alias("head_p"), "nth",
        )
        # The triangle inequality through each of the first pivots: distances of linked documents differ by 0.2 at most.
        apart = F.exists(F.zip_with("far", "far_p", lambda x, y: F.coalesce(F.abs(x - y) > 0.2 + 1e-9, F.lit(False))), lambda x: x)
        window = ~F.coalesce(apart, F.lit(False))
        pairs = (
            state.join(pivots, "region")
            .filter((F.col("comp") != F.col("comp_p")) & (F.col("node") != F.col("p")))
            .filter((5 * F.least("n", "n_p") >= 4 * F.greatest("n", "n_p")) & window)
            .filter(F.least("large", "large_p") >= enough("n", "n_p") - 1)
            # A pair that shares an earlier region of both heads comes up there.
            .filter(~F.exists(F.array_intersect("head", "head_p"), lambda r: r < F.col("region")))
            .select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))
            .distinct()
        )
        measured = materialise(measure(pairs, sets), "measured")
        if number == 0:
            far = measured.select("a", "b", (1 - F.col("shared") / F.col("joint")).alias("d"))
            first = state.join(pivots.filter(F.col("nth") <= FAR).select("region", "p", "nth"), "region")
            first = first.select("region", "node", "nth", F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))
            d = first.join(far, ["a", "b"]).groupBy("region", "node").agg(
                F.array(*[F.max(F.when(F.col("nth") == k, F.col("d"))) for k in range(1, FAR + 1)]).alias("d")
            )
            members = members.join(d, ["region", "node"], "left")
            members = materialise(members.withColumn("far", F.coalesce("d", "far")).drop("d"), "members")
        comp = joined(comp, measured.filter(linked()).select("a", "b"))
        done += more
        number += 1


def _join_regions(rows: DataFrame, hashes: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of small regions with how many they share, members of large ones, and each member's number of large ones.

    rows: an id, and a text or a set.
    """
    tasks = max(1, -(-hashes // TASK_HASHES), least)
    packed = rows.mapInArrow(lean(_postings(tasks)), "bucket int, low binary, high binary, node binary, size binary")
    packed = materialise(packed, "postings")
    schema = "kind int, a bigint, b bigint, n_a bigint, n_b bigint"
    cold = packed.filter("bucket >= 0").repartition(tasks, "bucket").mapInArrow(lean(_regions), schema)
    found = materialise(cold.unionByName(packed.filter("bucket < 0").mapInArrow(lean(_members), schema)), "found")
    member = found.filter("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("region"), F.col("n_a").alias("n"))
    large = materialise(member.groupBy("node", "n").agg(F.count_distinct("region").alias("large")), "large")
    small = found.filter("kind = 0").groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("same"))
    return small, member, large


def _enough(pairs: DataFrame, large: DataFrame, need: Column) -> DataFrame:
    """Pairs that share `need` hashes, less those that may lie in large regions and one that 48 bits may have merged."""
    own = large.select("node", "large")
    pairs = pairs.join(own.select(F.col("node").alias("a"), F.col("large").alias("l_a")), "a", "left")
    pairs = pairs.join(own.select(F.col("node").alias("b"), F.col("large").alias("l_b")), "b", "left")
    hidden = F.least(F.coalesce("l_a", F.lit(0)), F.coalesce("l_b", F.lit(0)))
    return pairs.filter(F.col("same") >= need - hidden - 1)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), "text")
    classes = materialise(own.mapInArrow(lean(_sets), "doc_id bigint, n bigint, mark binary"), "sets")
    # Equal sets are one class, named by its least id; counted in every map task first.
    alike = classes.filter("mark is not null").groupBy("mark").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows"))
    alike = materialise(alike.filter("rows > 1").select("mark", "node"), "alike")
    named = materialise(
        classes.join(alike, "mark", "left").select("doc_id", "n", F.coalesce("node", "doc_id").alias("node")), "classes"
    )
    copies = named.filter("doc_id <> node").select("doc_id").distinct()
    total = named.filter("doc_id = node").agg(F.sum(F.floor(F.col("n") * 3 / 10) + 1)).first()[0] or 0
    small, member, large = _join_regions(_only(own, copies, "left_anti"), int(total), docs.rdd.getNumPartitions())
    dense = large.filter(is_dense(F.col("n"), F.col("large"))).select("node")
    need = 1 + F.floor(F.least("n_a", "n_b") / 10)
    pairs = materialise(_enough(small, large, need).select("a", "b"), "pairs")
    dense = materialise(dense, "dense")
    nodes = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(dense).distinct()
    nodes = materialise(nodes, "nodes")
    sets = materialise(_only(own, nodes, "left_semi").mapInArrow(lean(_whole_sets), "node bigint, hashes array<bigint>"), "whole")
    again = sets.join(dense, "node", "left_semi").select("node", "hashes")
    total = again.agg(F.sum(F.size("hashes"))).first()[0] or 0
    small, member, large = _join_regions(again, int(total), sets.rdd.getNumPartitions())
    more = materialise(_enough(small, large, enough("n_a", "n_b")).select("a", "b"), "more-pairs")
    common = large.filter(is_common(F.col("n"), F.col("large")))
    members = materialise(_prefixes(member.join(common, ["node", "n"])), "members")
    every = pairs.union(more).distinct()
    links = materialise(measure(every, sets).filter(linked()).select("a", "b"), "links")
    comp = _pivot_rounds(members, sets, links)
    rows = named.join(comp, "node", "left").withColumn("c", F.coalesce("comp", "node"))
    return rows.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("c") != NO_ID, F.col("c")).alias("component_id"),
    )
