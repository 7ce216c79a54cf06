"""Conversation prefix trie with sums over subtrees by pointer jumping.

Turns are numbered, conversations rebuilt, every prefix gets a digest, equal digests are one node, and edges join the
digest of a prefix to that of the prefix one turn shorter. Sums over subtrees take as many rounds as the binary
logarithm of the depth: in round k every node adds what lies less than 2^k below it to its ancestor 2^k above and
learns that ancestor's ancestor, so only nodes of a depth of 2^k and more are left in round k.

A prefix digest must not need its conversation in one place: turns are dealt by ranges, each (range,
conversation) is summed by itself, and sums of the ranges before are added. So a lane of the digest is the sum, modulo
2^32, of hashes of (place, role, text) over the prefix; there are six lanes, 192 bits, and node keys are SHA-256 of depth and
lanes. A conversation of any length is spread over as many ranges as its rows fill.

Defined results: turns are ordered by (turn, role, text), nulls of turn first, null role or text is empty; repeated turns are
turns of their own. Rows without conv_id belong to no conversation. ``conv_id % 100`` has the sign of conv_id, as in SQL.
Further columns are dropped. An empty table has no node, not even a root. Texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shuffle_width, table

#: Lanes of a prefix digest, 32 bits each; two come from each 64-bit hash.
_SEEDS = (11, 23, 37)
_LANES = [f"lane{i}" for i in range(2 * len(_SEEDS))]
_MASK = (1 << 32) - 1
#: Ids of members written in one string before the strings of a node are hashed in order.
_RUN = 4096
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """part, conv_id, pos, body (hash of role and text), n_chars: turns in order, numbered from 1.

    Ranges of (conv_id, turn) keep the order of a conversation over parts; within a part rows are sorted."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    dealt = rows.repartitionByRange(shuffle_width(spark), F.col("conv_id"), F.col("turn").asc_nulls_first()).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    body = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    placed = dealt.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "conv_id", body.alias("body"), F.length("text").cast("long").alias("n_chars"))
    written = materialize(placed, "turns")
    before = _before(written.groupBy("part", "conv_id").agg(F.count("*").alias("n")), ["n"])
    own = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("place"))
    return written.join(before, ["part", "conv_id"]).select("part", "conv_id", (own + F.col("n")).cast("long").alias("pos"), "body", "n_chars")


def _before(sums: DataFrame, columns: list[str]) -> DataFrame:
    """Of (part, conv_id) sums, those over earlier parts of the conversation: a row a part, whatever its length."""
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", "conv_id", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in columns])


def rebuilt_turns(conversations: DataFrame, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(part, conv_id, depth, body, n_chars) of rebuilt conversations, and (conv_id, n_turns) of all, turnless ones too."""
    turns = materialize(numbered_turns(conversations), "numbered")
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    sizes = sizes.select("conv_id", "own", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    heads = turns.filter((F.col("pos") <= most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "pos", "body", "n_chars")
    given = sizes.join(heads.groupBy("base").agg(F.max("pos").alias("n_base")), "base", "left")
    given = materialize(given.select("conv_id", "own", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("k")), "heads")
    # at most ``group`` conversations and ``most`` turns share a base
    prefix = given.join(heads, "base").filter("pos <= h").select(F.lit(-1).alias("part"), "conv_id", F.col("pos").alias("depth"), "body", "n_chars")
    shift = turns.groupBy("part", "conv_id").agg(F.lit(1).alias("one")).join(given, "conv_id").select("part", "conv_id", "h", "k")
    rest = turns.join(shift, ["part", "conv_id"]).filter("pos > h").select("part", "conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "body", "n_chars")
    return prefix.unionByName(rest), given.select("conv_id", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns"))


def _key(depth, lanes: list) -> F.Column:
    return F.unhex(F.sha2(F.concat_ws(",", depth.cast("string"), *[lane.bitwiseAND(_MASK).cast("string") for lane in lanes]), 256))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, n_chars: the digest of every prefix and of the prefix one turn shorter."""
    hashes = [F.xxhash64(F.lit(seed), "depth", "body") for seed in _SEEDS]
    lanes = [x for h in hashes for x in (h.bitwiseAND(_MASK), F.shiftrightunsigned(h, 32))]
    laned = turns.select("part", "conv_id", "depth", "n_chars", *[x.alias(c) for x, c in zip(lanes, _LANES, strict=True)])
    before = _before(laned.groupBy("part", "conv_id").agg(*[F.sum(c).bitwiseAND(_MASK).alias(c) for c in _LANES]), _LANES)
    running = Window.partitionBy("part", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    given = before.select("part", "conv_id", *[F.col(c).alias(f"{c}_before") for c in _LANES])
    upto = laned.join(given, ["part", "conv_id"]).withColumns({f"{c}_upto": F.sum(c).over(running) + F.col(f"{c}_before") for c in _LANES})
    node = _key(F.col("depth"), [F.col(f"{c}_upto") for c in _LANES])
    parent = _key(F.col("depth") - 1, [F.col(f"{c}_upto") - F.col(c) for c in _LANES])
    return upto.select("conv_id", "depth", node.alias("node"), parent.alias("parent"), "n_chars")


def _root_key() -> F.Column:
    return _key(F.lit(0), [F.lit(0).cast("long")] * len(_LANES))


def _end_hashes(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of (node, conv_id). Ids of one run of 4,096 are joined first; the strings of a node then stream
    through one hash in order, never held together."""
    run_of = F.floor(F.col("conv_id") / _RUN)
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    runs = ends.groupBy("node", run_of.alias("run")).agg(F.array_join(ids, ",").alias("ids"))
    ordered = runs.repartition("node").sortWithinPartitions("node", "run")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        node, state = None, None
        for batch in batches:
            nodes, found = [], []
            for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key != node:
                    if node is not None:
                        nodes.append(node)
                        found.append(state.hexdigest())
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return ordered.select("node", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, columns: list[str], deepest: int) -> DataFrame:
    """node and the sum of each of ``columns`` over its subtree, of (node, parent, depth, columns); the root's parent is null.

    ``deepest`` is the greatest depth. After round k a node holds all that lies less than 2^(k+1) below it."""
    spread = F.when(F.col("parent").isNotNull(), F.col("parent")).alias("up")
    current = materialize(nodes.select("node", spread, "depth", *columns), "jump")
    done, reach = None, 1
    while reach <= deepest:
        # by now ``up`` is the ancestor ``reach`` above; nodes of less depth only receive
        gifts = current.filter(F.col("depth") >= reach).groupBy(F.col("up").alias("node")).agg(*[F.sum(c).alias(f"{c}_gift") for c in columns])
        above = current.filter((F.col("depth") >= reach) & F.col("up").isNotNull()).select(F.col("node").alias("up"), F.col("up").alias("higher"))
        # nodes of a depth of 2 reach and more look up their ancestor's ancestor, the others have none left
        moving, resting = current.filter(F.col("depth") >= 2 * reach).join(above, "up", "left"), current.filter(F.col("depth") < 2 * reach)
        moved = moving.select("node", F.col("higher").alias("up"), "depth", *columns).unionByName(resting.select("node", F.lit(None).cast("binary").alias("up"), "depth", *columns))
        summed = moved.join(gifts, "node", "left").select("node", "up", "depth", *[(F.col(c) + F.coalesce(F.col(f"{c}_gift"), F.lit(0))).alias(c) for c in columns])
        following = materialize(summed, "jump")
        discard(current)
        current, reach = following, 2 * reach
    return current.select("node", *columns)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, sizes = rebuilt_turns(conversations)
    found = materialize(prefixes(turns), "prefixes")
    inner = found.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars"))
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(_root_key().alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("n_chars"))
    nodes = materialize(inner.unionByName(root), "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    n_children = F.coalesce("n_children", F.lit(0)).alias("n_children")
    nodes = materialize(nodes.join(children, "node", "left").select(*nodes.columns, n_children), "nodes")
    own = nodes.select("node", "parent", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(own, ["n_leaves", "saved_tokens"], deepest)
    last = found.join(sizes.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"]).select("node", "conv_id")
    turnless = sizes.filter("n_turns = 0").select(_root_key().alias("node"), "conv_id")
    ends = _end_hashes(last.unionByName(turnless))
    names = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(names, "parent", "left").join(sums, "node").join(ends, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def oracle() -> str:
    """The contract by whole prefixes as lists: every node is compared with every other, so for small tables only."""
    crc = """list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END))"""
    return f"""
WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
drawn AS (SELECT conv_id, turns, (xor({crc}, 4294967295::UBIGINT) % 6)::BIGINT AS h FROM own),
rebuilt AS (SELECT d.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, d.h), list_slice(d.turns, d.h + 1, len(d.turns))) AS turns FROM drawn d LEFT JOIN own b ON b.conv_id = d.conv_id - d.conv_id % 100),
reached AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt),
keyed AS (SELECT conv_id, depth, len(turns) AS n, list_slice(turns, 1, depth) AS path FROM reached),
node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth)), sha256('')) AS ends_sha256 FROM keyed GROUP BY path, depth),
linked AS (SELECT c.*, p.conv_id AS parent_conv_id, CASE WHEN c.depth = 0 THEN 0 ELSE (c.n_convs - 1) * length(c.path[c.depth].t) END AS saved, (SELECT count(*) FROM node k WHERE k.depth = c.depth + 1 AND list_slice(k.path, 1, c.depth) = c.path) AS n_children
  FROM node c LEFT JOIN node p ON p.depth = c.depth - 1 AND p.path = list_slice(c.path, 1, c.depth - 1))
SELECT a.conv_id, a.depth::BIGINT AS depth, any_value(a.parent_conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children,
  count(*) FILTER (u.n_children = 0) AS n_leaves, sum(u.saved)::BIGINT AS saved_tokens, any_value(a.ends_sha256) AS ends_sha256
FROM linked a JOIN linked u ON u.depth >= a.depth AND list_slice(u.path, 1, a.depth) = a.path GROUP BY a.path, a.depth, a.conv_id"""
