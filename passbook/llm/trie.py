"""Trie of the common beginnings of conversations, with sums over subtrees by heavy paths.

A node is a sequence of turns that some conversation begins with. Its name is its
depth and two 64-bit hashes, each the exclusive or of the hashes of its turns with
their places: names need no order of computation, so that one conversation may
spread over many tasks (two nodes of one depth get one name by a chance of 2^-128).
Rows are sorted by conversation and turn into ranges; a conversation that passes a
range's end goes on in the next one, and what ranges need of earlier ones (turns,
hashes) is summed by range.

The largest child of each node (by members) continues its path, the others begin
paths of their own: whatever the depth, at most log2 of the conversations lie above
one another. Sums over subtrees are sums from a node to the end of its path, of the
nodes themselves and of the paths attached to them; each round finishes the paths
whose attached paths are finished.

Defined cases: rows without a conv_id belong to no conversation and are left out.
Turns are in order of turn (null first), then role, then text; null role and text
are empty, repeated turns count each. Of an empty table nothing comes. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, partitions, stash, table

#: Conversations share the beginnings of the first of each hundred, up to this many turns less one.
HUNDRED, HEADS = 100, 6
#: Ids in a block of the ends of a node; characters of role and text that ranges are cut by.
BLOCK, LEAD = 4096, 32
KEY = ["depth", "g1", "g2"]


def in_ranges(conversations: DataFrame) -> DataFrame:
    """Turns in order: conv_id, part (range), at (place in it), c1 and c2 (hashes of role and text), size (code points of the text)."""
    spark = conversations.sparkSession
    t = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = ["conv_id", "turn", F.left("role", F.lit(LEAD)), F.left("text", F.lit(LEAD))]
    lined = t.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "role", "text").withColumn("id", F.monotonically_increasing_id())
    return lined.select("conv_id", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("at"), F.xxhash64("role", "text").alias("c1"), F.xxhash64(F.lit("second"), "role", "text").alias("c2"), F.length("text").cast("long").alias("size"))


def before(key: str, desc: bool = False):
    """All earlier (or later) ranges of one key."""
    return Window.partitionBy(key).orderBy(F.col("part").desc() if desc else F.col("part")).rowsBetween(Window.unboundedPreceding, -1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, convs): the turns of every rebuilt conversation with the node that each ends at, and every conversation with its number of turns.

    A conversation has the first h turns of the first of its hundred, then its own after its first h.
    """
    runs = turns.groupBy("conv_id", "part").agg(F.min("at").alias("from"), F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    runs = runs.select("conv_id", "part", "from", F.coalesce(F.sum("n").over(before("conv_id")), F.lit(0)).alias("earlier"), F.sum("n").over(whole).alias("own"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base"))
    heads = runs.where("conv_id = base").groupBy("base").agg(F.max("own").alias("given"))
    runs, _ = stash(runs.join(heads, "base", "left").withColumn("k", F.least("h", F.coalesce("given", F.lit(0)))).withColumn("total", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).drop("given"))
    convs = runs.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in ("h", "k", "base", "total")])

    placed = turns.join(runs, ["conv_id", "part"]).withColumn("pos", F.col("at") - F.col("from") + F.col("earlier") + 1)
    own = placed.where("pos > h").select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "c1", "c2", "size", "total")
    first = placed.where(f"conv_id = base and pos < {HEADS}").select("base", "pos", "c1", "c2", "size")
    shared = convs.join(first, "base").where("pos <= k").select("conv_id", F.lit(-1).cast("long").alias("part"), F.col("pos").alias("depth"), "c1", "c2", "size", "total")
    x = own.unionByName(shared).withColumn("x1", F.xxhash64("depth", "c1")).withColumn("x2", F.xxhash64(F.lit("second"), "depth", "c2"))

    carry = x.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    zero = F.lit(0).cast("long")
    carry = carry.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"y{k}").over(before("conv_id")), zero).alias(f"y{k}") for k in (1, 2)])
    run = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    g = [F.bit_xor(f"x{k}").over(run).bitwiseXOR(F.col(f"y{k}")).alias(f"g{k}") for k in (1, 2)]
    named = x.join(carry, ["conv_id", "part"]).select("conv_id", "part", "depth", "size", (F.col("depth") == F.col("total")).alias("last"), "x1", "x2", *g)
    return named.select("conv_id", "part", *KEY, *[F.col(f"g{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)], "size", "last"), convs


def ends(members: DataFrame, convs: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at each node, in order, with commas between.

    Ids are sorted in ranges and written in blocks; a digest reads its blocks one after another and keeps none.
    """
    spark = members.sparkSession
    bound_batches(spark)
    zero = F.lit(0).cast("long")
    last = members.where("last").select(*KEY, "conv_id").unionByName(convs.where("total = 0").select(zero.alias("depth"), zero.alias("g1"), zero.alias("g2"), "conv_id"))
    n = partitions(spark)
    lined = last.repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = lined.groupBy(*KEY, "block").agg(text.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        row = lambda: pa.RecordBatch.from_pylist([dict(zip(KEY, node, strict=True)) | {"ends_sha256": digest.hexdigest()}])
        for batch in batches:
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node:
                    if node is not None:
                        yield row()
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if node is not None:
            yield row()

    some = Window.partitionBy(*KEY)
    blocks = blocks.withColumn("n", F.count("*").over(some))
    one = blocks.where("n = 1").select(*KEY, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    many = blocks.where("n > 1").repartition(n, *KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids").mapInArrow(run, "depth long, g1 long, g2 long, ends_sha256 string")
    return one.unionByName(many)


def nodes(members: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node: its key, parent's hashes p1 and p2, conv_id (least member), n_convs, n_children, saved (its own), light (no largest child)."""
    zero = F.lit(0).cast("long")
    below = members.groupBy(*KEY).agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"))
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("depth"), zero.alias("g1"), zero.alias("g2"), none.alias("p1"), none.alias("p2"), "conv_id", "n_convs", zero.alias("size"))
    largest = F.max_by(F.struct("g1", "g2"), F.struct("n_convs", F.bitwise_not("conv_id"))).alias("c")
    families = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("g1"), F.col("p2").alias("g2")).agg(F.count("*").alias("n_children"), largest)
    heavy = families.select((F.col("depth") + 1).alias("depth"), F.col("c.g1").alias("g1"), F.col("c.g2").alias("g2"), F.lit(False).alias("light"))
    out = below.unionByName(root).join(families.drop("c"), KEY, "left").join(heavy, KEY, "left")
    return out.select(*KEY, "p1", "p2", "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), F.coalesce("light", F.lit(True)).alias("light"))


def on_paths(tree: DataFrame, members: DataFrame) -> DataFrame:
    """``tree`` with path (least member of the node where it ends), part (range of that conversation) and top (depth where the path begins).

    The members of a path's last node pass all of its nodes; above its last light node another path goes on.
    """
    leaves = tree.where("n_children = 0").select(F.col("conv_id").alias("path"))
    passed = members.select(F.col("conv_id").alias("path"), "part", *KEY).join(leaves, "path", "left_semi")
    tops = passed.join(tree.where("light").select(*KEY), KEY).groupBy("path").agg(F.max("depth").alias("top"))
    paths = leaves.join(tops, "path", "left").select("path", F.coalesce("top", F.lit(0)).alias("top"))
    zero = F.lit(0).cast("long")
    spots = passed.join(paths, "path").where("depth >= top").select(*KEY, "path", "part", "top")
    root = paths.where("top = 0").select(zero.alias("depth"), zero.alias("g1"), zero.alias("g2"), "path", F.lit(-2).cast("long").alias("part"), "top")
    return tree.join(spots.unionByName(root), KEY)


def subtree_sums(tree: DataFrame) -> DataFrame:
    """(key, n_leaves, saved_tokens) of every node, round by round: paths of which all attached paths are done."""
    spark = tree.sparkSession
    sums = {"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": F.col("saved")}
    # Of a node's children all but the largest begin paths of their own.
    waiting, path = stash(tree.groupBy("path").agg(F.sum(F.greatest(F.col("n_children") - 1, F.lit(0))).alias("open")))
    done: DataFrame | None = None
    attached: DataFrame | None = None
    while waiting.limit(1).count():
        ready = tree.join(waiting.where("open = 0").select("path"), "path")
        if attached is not None:
            ready = ready.join(attached.groupBy(*KEY).agg(*[F.sum(f"up_{c}").alias(f"up_{c}") for c in sums]), KEY, "left")
        own: dict[str, Column] = {c: v + (F.coalesce(f"up_{c}", F.lit(0)) if attached is not None else 0) for c, v in sums.items()}
        vals = ready.select(*KEY, "p1", "p2", "path", "part", "top", *[v.alias(c) for c, v in own.items()])
        later = vals.groupBy("path", "part").agg(*[F.sum(c).alias(c) for c in sums]).select("path", "part", *[F.coalesce(F.sum(c).over(before("path", desc=True)), F.lit(0)).alias(f"later_{c}") for c in sums])
        rest = Window.partitionBy("path", "part").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
        summed = vals.join(later, ["path", "part"]).select(*KEY, "p1", "p2", (F.col("depth") == F.col("top")).alias("first"), *[(F.sum(c).over(rest) + F.col(f"later_{c}")).alias(c) for c in sums])
        found, _ = stash(summed)
        up, _ = stash(found.where("first and depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("g1"), F.col("p2").alias("g2")).agg(F.count("*").alias("closed"), *[F.sum(c).alias(f"up_{c}") for c in sums]))
        closed = up.join(tree.select(*KEY, "path"), KEY).groupBy("path").agg(F.sum("closed").alias("closed"))
        left, new = stash(waiting.where("open > 0").join(closed, "path", "left").select("path", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open")))
        discard(spark, path)
        waiting, path = left, new
        found = found.select(*KEY, *sums)
        done = found if done is None else done.unionByName(found)
        attached = up if attached is None else attached.unionByName(up)
    return done if done is not None else tree.select(*KEY, *[v.alias(c) for c, v in sums.items()])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, _ = stash(in_ranges(conversations))
    rows, convs = rebuilt(turns)
    members, _ = stash(rows)
    tree, _ = stash(nodes(members, convs))
    tree, _ = stash(on_paths(tree, members))
    sums = subtree_sums(tree)
    parents = tree.select((F.col("depth") + 1).alias("depth"), F.col("g1").alias("p1"), F.col("g2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = tree.select(*KEY, "p1", "p2", "conv_id", "n_convs", "n_children").join(parents, ["depth", "p1", "p2"], "left")
    out = named.join(sums, KEY).join(ends(members, convs), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the trie of all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
#: A node is named by the text of its turns; sums go to all nodes above, one after another.
SQL = f"""WITH t AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL
), c AS MATERIALIZED (SELECT conv_id, {_CRC} % {HEADS} AS h, conv_id - conv_id % {HUNDRED} AS base FROM (SELECT DISTINCT conv_id FROM t)
), r AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.base WHERE pos <= h UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h
), d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, role, text FROM r
), m AS MATERIALIZED (SELECT conv_id, depth, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path, length(text) AS size FROM d UNION ALL SELECT conv_id, 0, '', 0 FROM c
), n AS MATERIALIZED (SELECT depth, path, min(conv_id) AS id, count(*) AS n_convs, max(size) AS size FROM m GROUP BY depth, path
), e AS MATERIALIZED (SELECT m.conv_id, m.depth, n.id, m.depth = max(m.depth) OVER (PARTITION BY m.conv_id) AS last FROM m JOIN n ON n.depth = m.depth AND n.path = m.path
), x AS MATERIALIZED (SELECT n.id, n.depth, n_convs, (n_convs - 1) * size AS saved, p.id AS parent FROM n LEFT JOIN e p ON p.conv_id = n.id AND p.depth = n.depth - 1
), k AS MATERIALIZED (SELECT parent AS id, depth - 1 AS depth, count(*) AS n FROM x WHERE depth > 0 GROUP BY ALL
), s AS (SELECT a.id, a.depth, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(x.saved) AS saved FROM x LEFT JOIN k ON k.id = x.id AND k.depth = x.depth JOIN e a ON a.conv_id = x.id AND a.depth <= x.depth GROUP BY a.id, a.depth
), z AS (SELECT id, depth, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM e WHERE last GROUP BY id, depth)
SELECT x.id AS conv_id, CAST(x.depth AS BIGINT) AS depth, x.parent AS parent_conv_id, CAST(x.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(z.sha, sha256('')) AS ends_sha256
FROM x LEFT JOIN k ON k.id = x.id AND k.depth = x.depth JOIN s ON s.id = x.id AND s.depth = x.depth LEFT JOIN z ON z.id = x.id AND z.depth = x.depth"""
