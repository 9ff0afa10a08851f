"""A prefix trie of conversations by ROLLUP over positional columns of turn ids.

A turn's id is the 128-bit digest of its role and text, with the length of the text behind it. A conversation lies in rows of
``BLOCK`` ids; the row of a later block is keyed by the node where the block before ended. One ``GROUP BY block, node,
ROLLUP(t1, ..., t8)`` then aggregates all prefixes of all blocks together, and ``grouping_id`` tells how many ids a group has.
The name of a node is the XOR of a 128-bit hash per (position, id) of its turns, so the node before a block is known from
running XORs and no round waits for another.

Subtree sums come from a second ROLLUP. Every node is represented by its smallest member, and the nodes that one conversation
represents are the deep end of its path; so the sum below a node is the sum over its members of what they represent at that
depth or below: a suffix sum along each conversation.

No step gathers a conversation or a node: positions, running XORs and suffix sums go by pieces of at most ``PIECE`` entries and
sums of pieces. Only a SHA-256 needs its bytes in order: the ids of the conversations that end in one node are joined in pieces
first, and one task then reads the pieces as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import stored

BLOCK = 8
PIECE = 1024
#: Ids of conversations per joined piece.
ENDS = 512
IDS = [f"t{i}" for i in range(1, BLOCK + 1)]
NO_TURN = -(1 << 62)


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that name role and text, and 4 with the number of code points of the text."""
    name = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return F.concat(name, F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")))


def text_length(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 4)), 16, 10).cast("long")


def hashes(position: Column, turn: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), position, turn), F.xxhash64(F.lit(2), position, turn)


def running(df: DataFrame, key: str, at: str, values: list[str], agg: Callable, later: bool = False) -> DataFrame:
    """Adds ``<value>_before``: ``agg`` over the rows of the same key with a smaller ``at`` (larger: ``later``), 0 if none."""
    df = df.withColumn("_piece", F.floor(F.col(at) / PIECE))
    order = F.desc if later else F.asc
    outer = Window.partitionBy(key).orderBy(order("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(key, "_piece").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(key, "_piece").agg(*[agg(v).alias(f"_{v}") for v in values]).select(
        key, "_piece", *[F.coalesce(agg(f"_{v}").over(outer), F.lit(0)).alias(f"_{v}") for v in values])
    both = df.withColumns({f"{v}_before": F.coalesce(agg(v).over(inner), F.lit(0)) for v in values}).join(sums, [key, "_piece"])
    join = (lambda a, b: a.bitwiseXOR(b)) if agg is F.bit_xor else (lambda a, b: a + b)
    return both.withColumns({f"{v}_before": join(F.col(f"{v}_before"), F.col(f"_{v}")) for v in values}).drop(
        "_piece", *[f"_{v}" for v in values])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, position from 1, turn_id) in order of turn, null first; turns of one number go by their id."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        turn_id(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]).alias("turn_id"))
    turns = turns.withColumn("piece", F.coalesce(F.floor(F.col("turn") / PIECE), F.lit(NO_TURN)))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy("conv_id", "piece").agg(F.count("*").alias("n")).select(
        "conv_id", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "piece").orderBy(F.asc_nulls_first("turn"), "turn_id")
    return turns.withColumn("at", F.row_number().over(inside)).join(sizes, ["conv_id", "piece"]).select(
        "conv_id", (F.col("at") + F.col("before")).alias("position"), "turn_id")


def rebuilt(own: DataFrame, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that share the opening turns of the first of their group.

    Conversation c begins with the first h turns of c - c % group (h = crc32(decimal c) % (most + 1)) and goes on with its own
    after its first h. Returns (conv_id, length) of every conversation and (conv_id, position, turn_id).
    """
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % group,
        "h": F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (most + 1)})
    convs = convs.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    tail = own.join(convs.select("conv_id", "h", "taken"), "conv_id").where("position > h").select(
        "conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), "turn_id")
    opening = own.where(F.col("position") <= most).withColumnRenamed("conv_id", "base")
    head = opening.join(convs.select("conv_id", "base", "taken"), "base").where("position <= taken").select(
        "conv_id", "position", "turn_id")
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return lengths, head.unionByName(tail)


def blocks(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows of BLOCK turn ids (null: none left) with the name p1, p2 of the node before the row.

    A conversation without turns has one row without ids.
    """
    slot = (F.col("position") - 1) % BLOCK
    h1, h2 = hashes(F.col("position"), F.col("turn_id"))
    full = turns.withColumns({"block": F.floor((F.col("position") - 1) / BLOCK), "h1": h1, "h2": h2}).groupBy("conv_id", "block").agg(
        *[F.max(F.when(slot == i, F.col("turn_id"))).alias(c) for i, c in enumerate(IDS)],
        F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    bare = lengths.where("length = 0").select(
        "conv_id", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("binary").alias(c) for c in IDS],
        *[F.lit(0).cast("long").alias(c) for c in ("x1", "x2")])
    rows = running(full.unionByName(bare), "conv_id", "block", ["x1", "x2"], F.bit_xor)
    return rows.withColumnsRenamed({"x1_before": "p1", "x2_before": "p2"})


def rolled(rows: DataFrame, sums: str) -> DataFrame:
    """One row per node (the root once): depth, its name n1, n2, its parent's q1, q2, the last turn's id, and ``sums``."""
    ids = ", ".join(IDS)
    groups = rows.sparkSession.sql(
        f"SELECT block, p1, p2, {ids}, grouping_id() AS open, {sums} FROM {{rows}} GROUP BY block, p1, p2, ROLLUP({ids})", rows=rows)
    held = F.lit(BLOCK) - F.bit_count("open")  # the ids of a group: grouping_id sets a bit for each column rolled up
    last = F.element_at(F.array(*IDS), held.cast("int"))
    groups = groups.withColumns({"held": held}).withColumn("last", F.when(F.col("held") > 0, last))
    groups = groups.where(F.col("last").isNotNull() | ((F.col("held") == 0) & (F.col("block") == 0)))
    parts = [hashes(F.col("block") * BLOCK + F.lit(i + 1), F.col(c)) for i, c in enumerate(IDS)]
    name = []
    for k in (0, 1):
        out = F.col(f"p{k + 1}")
        for i, part in enumerate(parts):
            out = out.bitwiseXOR(F.when(F.col("held") > i, part[k]).otherwise(F.lit(0)))
        name.append(out)
    depth = F.col("block") * BLOCK + F.col("held")
    groups = groups.withColumns({"depth": depth, "n1": name[0], "n2": name[1]})
    own = hashes(F.col("depth"), F.col("last"))
    up = [F.when(F.col("depth") > 0, F.col(f"n{k + 1}").bitwiseXOR(own[k])).alias(f"q{k + 1}") for k in (0, 1)]
    return groups.select("*", *up)


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 per node of the ids of ``ends`` (n1, n2, conv_id), ascending and joined by commas."""
    pieces = ends.withColumn("piece", F.floor(F.col("conv_id") / ENDS)).groupBy("n1", "n2", "piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for b in batches:
            out = []
            for n1, n2, ids in zip(*[b.column(i).to_pylist() for i in range(3)]):
                if (n1, n2) == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (n1, n2), hashlib.sha256(ids.encode())
            yield batch(out)
        if node is not None:
            yield batch([(*node, digest.hexdigest())])

    def batch(rows: list) -> pa.RecordBatch:
        n1, n2, text = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(n1, pa.int64()), pa.array(n2, pa.int64()), pa.array(text, pa.string())],
                                          ["n1", "n2", "ends_sha256"])

    ordered = pieces.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "piece")
    return ordered.select("n1", "n2", "ids").mapInArrow(run, "n1 long, n2 long, ends_sha256 string")


def trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of conversations given as by ``rebuilt``; no conversations, no nodes.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 as in
    ``op11_prefix_trie``, and n_ends, the conversations that end in the node.
    """
    rows = stored(blocks(lengths, turns), "blocks")
    nodes = stored(rolled(rows, "min(conv_id) AS conv_id, count(*) AS n_convs").select(
        "n1", "n2", "q1", "q2", "depth", "conv_id", "n_convs",
        F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * text_length(F.col("last"))).otherwise(F.lit(0)).alias("saved")), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("q1").alias("n1"), F.col("q2").alias("n2")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, ["n1", "n2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "families")

    slot = F.when(F.col("depth") > 0, (F.col("depth") - 1) % BLOCK).otherwise(F.lit(0))
    stands = nodes.withColumn("block", F.when(F.col("depth") > 0, F.floor((F.col("depth") - 1) / BLOCK)).otherwise(F.lit(0)))
    stands = stands.groupBy("conv_id", "block").agg(
        *[F.sum(F.when(slot == i, F.col("saved")).otherwise(F.lit(0))).alias(f"w{i + 1}") for i in range(BLOCK)],
        F.sum("saved").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"))
    paths = rows.join(stands, ["conv_id", "block"], "left").na.fill(0, [f"w{i + 1}" for i in range(BLOCK)] + ["saved", "leaf"])
    paths = running(paths, "conv_id", "block", ["saved", "leaf"], F.sum, later=True)
    below, suffix = F.col("saved_before"), {}
    for i in range(BLOCK, 0, -1):
        below = below + F.col(f"w{i}")
        suffix[f"s{i}"] = below
    paths = paths.withColumns({**suffix, "leaves": F.col("leaf") + F.col("leaf_before")}).where("s1 > 0 OR leaves > 0")
    sums = rolled(paths, ", ".join(f"sum(s{i}) AS s{i}" for i in range(1, BLOCK + 1)) + ", sum(leaves) AS n_leaves").select(
        "n1", "n2", "n_leaves",
        F.element_at(F.array(*[f"s{i}" for i in range(1, BLOCK + 1)]), F.greatest("held", F.lit(1)).cast("int")).alias("saved_tokens"))

    last = F.when(F.col("length") > 0, F.floor((F.col("length") - 1) / BLOCK)).otherwise(F.lit(0))
    ends = rows.join(lengths.select("conv_id", last.alias("block")), ["conv_id", "block"]).select(
        "conv_id", F.col("p1").bitwiseXOR(F.col("x1")).alias("n1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("n2"))
    ends = stored(ends, "ends")
    counts = ends.groupBy("n1", "n2").agg(F.count("*").alias("n_ends"))
    parents = nodes.select(F.col("n1").alias("q1"), F.col("n2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(sums, ["n1", "n2"]).join(ends_digest(ends), ["n1", "n2"], "left").join(counts, ["n1", "n2"], "left").join(
        parents, ["q1", "q2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        F.coalesce("n_ends", F.lit(0)).alias("n_ends"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``, each rebuilt on the opening of the first of its hundred.

    Null role or text counts as empty, a null turn comes first, turns of equal number go by the digest of role and text,
    repeated rows are turns of their own, other columns are ignored. Rows without conv_id belong to no conversation. ``c % 100``
    has the sign of c. saved_tokens sums (n_convs - 1) times the code points of the last text over the subtree, the node included.
    """
    lengths, turns = rebuilt(stored(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns"))
    return trie(stored(lengths, "lengths"), turns).drop("n_ends")


# CRC-32 bit by bit: every byte is followed by eight shifts (-1); 3988292384 is the reversed polynomial
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
  lambda s: [ord(s), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x::BIGINT) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"""
ORACLE = f"""
WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT *, {_CRC} % 6 AS h FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id)),
convs AS (SELECT a.conv_id, a.n, a.h, least(a.h, coalesce(b.n, 0)) AS taken FROM sizes a LEFT JOIN sizes b ON b.conv_id = a.conv_id - a.conv_id % 100),
turns AS (SELECT v.conv_id, o.pos, role, text FROM convs v JOIN own o ON o.conv_id = v.conv_id - v.conv_id % 100 AND o.pos <= taken
  UNION ALL SELECT v.conv_id, o.pos - h + taken, role, text FROM convs v JOIN own o ON o.conv_id = v.conv_id AND o.pos > h),
paths AS (SELECT conv_id, pos AS depth, length(text) AS size, string_agg(md5(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY pos) AS ids FROM turns),
prefixes AS MATERIALIZED (SELECT conv_id, depth, size, md5(ids) AS node, CASE WHEN depth > 1 THEN lag(md5(ids)) OVER (PARTITION BY conv_id ORDER BY depth) ELSE 'root' END AS parent FROM paths
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM convs),
nodes AS MATERIALIZED (SELECT node, depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved FROM prefixes GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent),
sums AS (SELECT p.node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM nodes v LEFT JOIN children k ON k.node = v.node JOIN prefixes p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.node),
ends AS (SELECT node, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS ends_sha256
  FROM prefixes p JOIN convs c ON p.conv_id = c.conv_id AND p.depth = taken + greatest(n - h, 0) GROUP BY node)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes v LEFT JOIN nodes u ON u.node = v.parent LEFT JOIN children k ON k.node = v.node JOIN sums s ON s.node = v.node LEFT JOIN ends e ON e.node = v.node"""
