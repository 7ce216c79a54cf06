"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Texts are sets of five-word shingles (lower case; a text of 1 to 4 words is one shingle). Texts
with one shingle set are one node. Each of ``trees`` prefix tries holds every node under a signature of
``max_depth`` minima; its path is kept as the trie node at the floor and the labels below it. Two
nodes are candidates in a tree if the prefix in use there is common to both. Prefixes start at their
full depth and are shortened until a pair at the threshold is found with probability ``recall``
(1 - the product of 1 - s^depth over the trees):

* the floor is the greatest depth that suffices if all trees use it; no prefix gets shorter;
* trie nodes of up to ``leaf`` members at the floor are shortened to it at once: that costs little;
* of its crowded trees, a node shortens those with the fewest members first, level by level, only until
  its recall is reached, and leaves the rest deep. A trie node takes the shortest prefix that one
  of its members asks for. What is crowded does not hang on any one pair, so the recall holds.

A set too small to have a partner other than itself at the threshold is not matched at all.

Verification is exact, on the whole shingle sets (64-bit hashes). Members of a trie node are compared with
each other where the pair first meets (in the tree of least number), never all candidates that chain
together: connected trie nodes are compared as one group only where that takes fewer comparisons than
they take one by one (copies of one text share most of their trie nodes). Either way the links
are the same, and classes are the components of verified links. A group of more than ``block``
nodes is dealt out as pairs of blocks, so no task holds a group and no pair becomes a row: a task
returns for each node its number of links and the least node it reaches. A task holds the sets of two
blocks; a very long text is one set in it.

Result, a row a document: doc_id, class_id (least doc_id of its connected class), n_links (other
shingle sets with Jaccard >= threshold), n_copies (documents with its shingle set, itself included).
Texts without words have no shingles: own class, no links, 1 copy. Rows with a null doc_id get a
null class and 0 links. Rows that repeat a doc_id are one document with several texts: each row is
returned, all get one class, linked sets are those of any of its texts. Further columns are not
read. An empty table gives an empty table.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table, text_or_empty
from .components import components
from .memory import task
from .textkit import mix, shingle_hashes, utf8_chunks, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, RECALL, LEAF = 20, 8, 0.999, 64


def recall_at(similarity: float, depth: int, trees: int) -> float:
    return 1 - (1 - similarity**depth) ** trees


def shortened_depth(threshold: float, recall: float, trees: int, max_depth: int) -> int:
    """The greatest depth up to ``max_depth`` at which pairs at the threshold are found often enough."""
    depth = max_depth
    while depth > 1 and recall_at(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def least_partnered(threshold: float) -> int:
    """Least set size that can reach the threshold with a set other than itself: n/(n+1) >= threshold."""
    n = 1
    while n / (n + 1) < threshold - 1e-12:
        n += 1
    return n


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(97))
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def crowded_depths(crowded: int, threshold: float, recall: float, trees: int, floor: int, max_depth: int) -> tuple[int, int]:
    """(depth, n): of ``crowded`` tries in the order of their members, the first n use this depth and the others one more, so
    that a pair at the threshold is found often enough; the other tries use the floor."""
    missed = (1 - threshold**floor) ** (trees - crowded)
    for depth in range(max_depth - 1, floor - 1, -1):
        for n in range(crowded + 1):
            if missed * (1 - threshold**depth) ** n * (1 - threshold ** (depth + 1)) ** (crowded - n) <= 1 - recall:
                return depth, n
    return floor, crowded


def label_bits(floor: int, max_depth: int) -> int:
    return min(32, 63 // max(1, max_depth - floor))


def signatures(hashes: np.ndarray, starts: np.ndarray, trees: int, floor: int, max_depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(sets, trees) trie nodes at the floor (the first minima of each tree as one number) and the labels below, first one
    highest. Sets are not empty."""
    a, b = _coefficients(trees * max_depth)
    bits = np.uint64(label_bits(floor, max_depth))
    keys, tails = np.empty((len(starts), trees), np.uint64), np.zeros((len(starts), trees), np.uint64)
    for t in range(trees):
        key = np.full(len(starts), t + 1, np.uint64)
        for d in range(max_depth):
            k = t * max_depth + d
            least = np.minimum.reduceat((hashes * a[k] + b[k]) >> np.uint64(32), starts)
            if d < floor:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            else:
                tails[:, t] = (tails[:, t] << bits) | (least & ((np.uint64(1) << bits) - np.uint64(1)))
        keys[:, t] = key
    return keys, tails


def distinct_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes of consecutive texts, bounds)."""
    for first, _, buf, offsets in utf8_chunks(texts):
        hashes, before = shingle_hashes(*word_hashes(buf, offsets), size)
        parts, sizes = [], []
        for lo, hi in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            own = np.sort(hashes[lo:hi])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            parts.append(own)
            sizes.append(len(own))
        yield first, np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))


_SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("tails", T.ArrayType(T.LongType()))])


def sign(documents: DataFrame, size: int, trees: int, floor: int, max_depth: int, least: int) -> DataFrame:
    """doc_id, h1, h2 (the shingle set), n, keys and tails (a tree each; none for a set below ``least`` shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, hashes, bounds in distinct_sets(batch.column("text"), size):
                n = np.diff(bounds)
                some = np.flatnonzero(n > 0)
                h1, h2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                width = np.where(n >= least, trees, 0)
                keys = tails = np.empty(0, np.int64)
                if len(some):
                    h1[some] = mix(np.add.reduceat(mix(hashes), bounds[some])).view(np.int64)
                    h2[some] = mix(np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), bounds[some])).view(np.int64)
                    keys, tails = (x[n[some] >= least].reshape(-1).view(np.int64) for x in signatures(hashes, bounds[some], trees, floor, max_depth))
                ends = pa.array(np.concatenate(([0], np.cumsum(width))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (keys, tails)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(n)), pa.array(h1), pa.array(h2), pa.array(n.astype(np.int32)), *lists], names=_SIGNED.names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_or_empty()).alias("text")).mapInArrow(task("ngrams")(run), _SIGNED)


def trie_nodes(nodes: DataFrame, threshold: float, recall: float, trees: int, floor: int, max_depth: int, leaf: int) -> DataFrame:
    """node, tree, cell, size, hub: the trie nodes in use with more than one member, a row a member. hub is the least one."""
    zipped = F.posexplode(F.arrays_zip("keys", "tails"))
    places = nodes.select("node", zipped.alias("tree", "x")).select("node", "tree", "x.keys", "x.tails")
    shared = places.groupBy("keys").agg(F.min("node").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    shared = materialize(places.join(shared, "keys"), "tries")
    crowded = shared.filter(F.col("size") > leaf)
    small = shared.select("node", "tree", F.col("keys").alias("cell"), "size", "hub")
    if crowded.isEmpty():
        return small
    plan = F.array(*[F.struct(*map(F.lit, crowded_depths(c, threshold, recall, trees, floor, max_depth))) for c in range(trees + 1)])
    own = Window.partitionBy("node")  # a row a tree
    ranked = crowded.select("node", "keys", "size", F.count("*").over(own).cast("int").alias("c"), F.row_number().over(own.orderBy("size", "keys")).alias("r"))
    ranked = ranked.withColumn("p", F.get(plan, F.least("c", F.lit(trees))))
    asked = ranked.select("keys", (F.col("p.col1") + F.when(F.col("r") > F.col("p.col2"), 1).otherwise(0)).alias("depth")).groupBy("keys").agg(F.min("depth").alias("depth"))
    labels = F.expr(f"shiftrightunsigned(tails, {label_bits(floor, max_depth)} * ({max_depth} - depth))")
    cell = F.when(F.col("depth") > floor, F.xxhash64("keys", "depth", labels)).otherwise(F.col("keys"))
    deep = crowded.join(asked, "keys").select("node", "tree", cell.alias("cell"))
    sizes = deep.groupBy("cell").agg(F.count("*").alias("size"), F.min("node").alias("hub")).filter("size > 1")
    return materialize(small.filter(F.col("size") <= leaf).unionByName(deep.join(sizes, "cell").select("node", "tree", "cell", "size", "hub")), "cells")


_WHOLE = -1


def candidate_groups(members: DataFrame, by_trie_node: bool) -> DataFrame:
    """grp, node, n (nodes of the group), tree, cells (of the node, by tree). Connected trie nodes are one group, of tree
    ``_WHOLE`` and without cells, where that takes no more comparisons; otherwise each trie node is a group."""
    # a node meets its hub in many trees: once is enough, and spares the hub's joins
    edges = members.select(F.col("node").alias("a"), F.col("hub").alias("b")).filter("a <> b").distinct()
    grouped = materialize(components(edges, "candidates"), "groups")
    sizes = grouped.groupBy("root").agg(F.count("*").alias("n"))
    whole = F.col("n").cast("double")
    none = F.lit(None).cast("array<struct<tree:int,cell:long>>").alias("cells")
    if by_trie_node:
        cost = members.filter("node = hub").join(grouped, "node").groupBy("root").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("cost"))
        sizes = materialize(sizes.join(cost, "root").select("root", "n", (F.col("cost") < whole * whole).alias("split")), "sizes")
    else:
        sizes = sizes.withColumn("split", F.lit(False))
    rooted = grouped.join(sizes, "root")
    out = rooted.filter("NOT split").select(F.col("root").alias("grp"), "node", "n", F.lit(_WHOLE).alias("tree"), none)
    if by_trie_node and not sizes.filter("split").isEmpty():
        apart = members.join(rooted.filter("split").select("node"), "node")
        own = apart.groupBy("node").agg(F.collect_list(F.struct("tree", "cell")).alias("cells"))
        out = out.unionByName(apart.join(own, "node").select(F.col("cell").alias("grp"), "node", F.col("size").alias("n"), "tree", "cells"))
    return out


def _links(sets: list[np.ndarray], left: int, threshold: float) -> np.ndarray:
    """Flag of each pair at or above the threshold; with left > 0 only pairs across the first ``left`` and the rest."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    common = np.zeros((m, m), np.float32)
    if m == 2:
        common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(m), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate(([True], flat[1:] != flat[:-1]))
        column = np.cumsum(new) - 1
        often = np.bincount(column) > 1
        keep = often[column]
        renamed = (np.cumsum(often) - 1)[column[keep]]
        owner = owner[keep]
        for lo in range(0, int(often.sum()), 4096):
            a, b = np.searchsorted(renamed, (lo, lo + 4096))
            x = np.zeros((m, 4096), np.float32)
            x[owner[a:b], renamed[a:b] - lo] = 1
            common += x @ x.T
    linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    np.fill_diagonal(linked, False)
    if left:
        linked[:left, :left] = False
        linked[left:, left:] = False
    return linked


def _first_met(linked: np.ndarray, cells: np.ndarray, tree: int) -> np.ndarray:
    """Of the linked pairs those that meet in no tree before ``tree``; cells has a row a node and a column a tree, 0 for none."""
    a, b = np.nonzero(np.triu(linked))
    out = np.zeros_like(linked)
    for at in range(0, len(a), 1 << 17):
        i, j = a[at : at + (1 << 17)], b[at : at + (1 << 17)]
        first = ((cells[i, : tree + 1] == cells[j, : tree + 1]) & (cells[i, : tree + 1] != 0)).argmax(axis=1)
        own = first == tree
        out[i[own], j[own]] = out[j[own], i[own]] = True
    return out


def _reach(linked: np.ndarray) -> np.ndarray:
    """Least index each node reaches."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(axis=1)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


_VERIFIED = "node long, root long, links long, whole boolean"


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """From rows (cell, side, whole, tree, cells, node, shingles) sorted by cell, side and node: links of each node in the cell
    and the least node reached. A row that repeats the one before (a repeated row of the input) is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def close() -> pa.RecordBatch | None:
            rows = held
            nodes = np.array([r[1] for r in rows])
            left = sum(r[0] == 0 for r in rows) if rows[-1][0] else 0
            if len(rows) < 2:
                return None
            linked = _links([r[2] for r in rows], left, threshold)
            if (tree := rows[0][4]) != _WHOLE:
                met = np.zeros((len(rows), max(tree, *(c["tree"] for r in rows for c in r[5])) + 1), np.int64)
                for i, r in enumerate(rows):
                    for c in r[5]:
                        met[i, c["tree"]] = c["cell"]
                linked = _first_met(linked, met, tree)
            order = np.argsort(nodes, kind="stable")
            label = order[_reach(linked[np.ix_(order, order)])]
            root = np.empty(len(nodes), np.int64)
            root[order] = nodes[label]
            counts = linked.sum(axis=1)
            some = counts > 0
            return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(root[some]), pa.array(counts[some].astype(np.int64)), pa.array(np.full(int(some.sum()), rows[0][3]))], names=["node", "root", "links", "whole"])

        for batch in batches:
            for cell, side, whole, tree, cells, node, data in zip(*(batch.column(c).to_pylist() for c in ("cell", "side", "whole", "tree", "cells", "node", "shingles")), strict=True):
                if cell != current:
                    if held and (got := close()) is not None:
                        yield got
                    current, held = cell, []
                shingles = np.frombuffer(data, np.uint64)
                if not held or held[-1][:2] != (side, node) or not np.array_equal(held[-1][2], shingles):
                    held.append((side, node, shingles, whole, tree, cells))
        if held and (got := close()) is not None:
            yield got

    return members.mapInArrow(task("ngrams")(run), _VERIFIED)


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """Replaces ``text`` by ``h1``-checkable ``shingles`` (sorted distinct hashes as bytes)."""
    keep = [c for c in texts.columns if c != "text"]
    schema = T.StructType([texts.schema[c] for c in keep] + [T.StructField("found", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, bounds in distinct_sets(batch.column("text"), size):
                n = len(bounds) - 1
                found = np.zeros(n, np.int64)
                some = np.flatnonzero(np.diff(bounds) > 0)
                if len(some):
                    found[some] = mix(np.add.reduceat(mix(hashes), bounds[some])).view(np.int64)
                packed = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found), pa.array(packed, pa.binary())], names=schema.names)

    return texts.mapInArrow(task("ngrams")(run), schema)


def jaccard_join(documents: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = RECALL, leaf: int = LEAF, block: int = 384) -> DataFrame:
    floor = shortened_depth(threshold, recall, trees, max_depth)
    signed = materialize(sign(documents, size, trees, floor, max_depth, least_partnered(threshold)), "signed")
    sets = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.max(F.struct("keys", "tails")).alias("x"))
    sets = materialize(sets.select("h1", "h2", "node", "copies", "x.*"), "sets")

    members = trie_nodes(sets, threshold, recall, trees, floor, max_depth, leaf)
    gc.collect()  # frames that nothing refers to any more hold their plans in the driver
    one_each = sets.groupBy("node").count().filter("count > 1").isEmpty()  # else a node has the cells of several sets
    grouped = candidate_groups(members, one_each).withColumn("blocks", F.ceil(F.col("n") / F.lit(float(block))).cast("int"))
    placed = grouped.join(sets.select("node", "h1"), "node")
    texts = documents.select(F.col("doc_id").cast("long").alias("node"), F.lower(text_or_empty()).alias("text"))
    full = shingle_sets(texts.join(placed, "node"), size).filter("found = h1").drop("found")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = full.withColumn("_b", own).withColumn("_o", other)
    low, high = F.least("_b", "_o"), F.greatest("_b", "_o")
    whole = (F.col("blocks") == 1) & (F.col("tree") == _WHOLE)
    cells = dealt.select(F.xxhash64("grp", "tree", low, high).alias("cell"), F.when(F.col("_b") > F.col("_o"), 1).otherwise(0).alias("side"), whole.alias("whole"), "tree", "cells", "node", "shingles")
    verified = materialize(verify(cells.repartition("cell").sortWithinPartitions("cell", "side", "node"), threshold), "verified")

    gc.collect()
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    edges = verified.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"), "whole")
    roots = edges.filter("whole").select(F.col("a").alias("node"), F.col("b").alias("root"))
    split = edges.filter("NOT whole")
    if not split.isEmpty():
        roots = roots.unionByName(components(split, "classes"))
    classes = links.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("class"), "links")

    known = sets.select("h1", "h2", "node", "copies").join(classes, "node", "left")
    known = known.select("h1", "h2", F.coalesce("class", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
    out = signed.select("doc_id", "h1", "h2", (F.col("n") > 0).alias("some")).join(known, ["h1", "h2"], "left")
    in_play = F.col("some") & F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.when(in_play, F.col("class")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(in_play, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(in_play, F.col("copies")).otherwise(F.lit(1)).cast("long").alias("n_copies"),
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
