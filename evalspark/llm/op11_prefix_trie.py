"""Prefix trie of conversations from padded turn-id matrices.

``prefix_trie`` takes conversations as turns in order and returns one row per
distinct sequence of first turns.  A turn is named by the first 16 bytes of the
SHA-256 of its role and text, followed by its length in code points; a
conversation is the string of its turns' names.  So every step below moves 20
bytes a turn, never a text.

1. Conversations are range-partitioned by (turn names, conv_id).  Equal
   conversations are told apart by their id, so a sequence that a third of all
   conversations share is spread over many shards.
2. A shard ranks its turn names, pads the ranks to a matrix of ``WIDTH``
   columns at a time and sorts the rows with ``numpy.lexsort``.  The change
   masks of the columns, OR-accumulated from the left, mark where nodes start;
   rows alone in their group leave the matrix, as all their deeper nodes are
   chains.  ``reduceat`` over the starts of a depth gives members, smallest
   member, children, leaves and saved tokens, from the deepest depth up.
3. Only nodes that hold a shard's first or last row can go on in another shard.
   Those come out as partial rows, named by a chained digest of their prefix,
   and are put together by aggregates; all other nodes are final.

The ids that end at a node are hashed in order.  A node that spans shards hands
over its ids in pieces, which one stream per node hashes in bounded memory
(SHA-256 cannot be split).

A conversation is one record: its turn names must fit a task's memory, its
texts need not.  Turns of a conversation are ordered by turn, null first, ties
by role and text in byte order; a null role or text counts as empty, repeated
rows are turns of their own.  Rows without a ``conv_id`` belong to no
conversation and are left out.  No conversation: no node, so no row.  Columns
beside the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.common import materialise, small_arrow_batches, table
from evalspark.session import ship_package

QUERY = "op11_prefix_trie"
NAME = np.dtype([("a", ">u8"), ("b", ">u8"), ("chars", ">u4")])
WIDTH = 8                 # columns of a padded matrix
SHARD_TURNS = 1 << 20     # turns of a shard, at most about
SMALL_SHARD = 1 << 13     # below this a shard is not worth a task
PIECE = 8192              # ids of one piece of a spanning node's list
EMPTY = hashlib.sha256(b"").hexdigest()
FINAL, EDGE, ENDS = 0, 1, 2
PARTS = ("kind int, shard bigint, paths int, depth bigint, node binary, parent binary, conv_id bigint, "
         "parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
         "chars bigint, ends string")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# ------------------------------------------------------------ one shard
def rank_names(names: np.ndarray) -> np.ndarray:
    """Ranks of turn names in byte order, from 1; equal names, equal ranks."""
    if not len(names):
        return np.zeros(0, np.int64)
    order = np.lexsort((names["b"], names["a"]))
    a, b = names["a"][order], names["b"][order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    out = np.empty(len(names), np.int64)
    out[order] = np.cumsum(new)
    return out


def sort_rows(ids: np.ndarray, lens: np.ndarray, convs: np.ndarray, width: int = WIDTH):
    """(order, lcp): the rows sorted by turn ids, then conv_id, and how many
    first turns each shares with the row before it (-1 for the first row)."""
    n = len(lens)
    starts = np.cumsum(lens) - lens
    order = np.lexsort((convs, np.zeros(n, np.int64)))
    lcp = np.full(n, -1, np.int64)
    rows = np.arange(n)        # places whose rows still share all turns so far with a neighbour
    group = np.zeros(n, np.int64)
    at = 0
    while len(rows):
        who = order[rows]
        pad = np.zeros((len(rows), width), np.int64)
        for c in range(width):
            has = lens[who] > at + c
            pad[has, c] = ids[starts[who[has]] + at + c]
        goes_on = lens[who] > at + width   # rows that end here come first, as their next column is padding
        sort = np.lexsort((convs[who], goes_on, *[pad[:, c] for c in range(width - 1, -1, -1)], group))
        pad, who, group = pad[sort], who[sort], group[sort]
        order[rows] = who
        # Column 0 of the mask stands for the turns before this matrix.
        change = np.zeros((len(rows), width + 1), bool)
        change[0] = True
        change[1:, 0] = group[1:] != group[:-1]
        change[1:, 1:] = pad[1:] != pad[:-1]
        change = np.logical_or.accumulate(change, axis=1)
        inside = ~change[:, 0]
        lcp[rows[inside]] = at + (width - change[inside, 1:].sum(axis=1))
        # A row that ended in this matrix has a zero in it: it shares at most its length.
        lcp[rows[inside]] = np.minimum(lcp[rows[inside]], np.minimum(lens[who[inside]], lens[order[rows[inside] - 1]]))
        new = change[:, width]
        group = np.cumsum(new)
        size = np.bincount(group)[group]
        at += width
        stay = (size > 1) & (lens[who] > at)
        rows, group = rows[stay], group[stay]
    return order, lcp


def _ends(convs: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, convs.tolist())).encode()).hexdigest()


def _chain(names: np.ndarray) -> list[bytes]:
    """Names of a row's prefixes, from the root's."""
    out = [hashlib.sha256(b"root").digest()[:16]]
    for e in names:
        out.append(hashlib.sha256(out[-1] + e.tobytes()).digest()[:16])
    return out


def shard_nodes(convs: np.ndarray, lens: np.ndarray, names: np.ndarray, shard: int) -> Iterator[dict]:
    """Column arrays of ``PARTS`` for one shard's rows, block by block."""
    n = len(lens)
    order, lcp = sort_rows(rank_names(names), lens, convs)
    starts = (np.cumsum(lens) - lens)[order]
    convs, lens, chars = convs[order], lens[order], names["chars"].astype(np.int64)
    shared = np.maximum(lcp, np.r_[lcp[1:], -1])
    shared = np.maximum(shared, 0)  # all rows share the root
    # The first and last row may go on in other shards: none of their nodes is final.
    shared[[0, n - 1]] = lens[[0, n - 1]]
    first, last = (_chain(names[starts[r]:starts[r] + lens[r]]) for r in (0, n - 1))
    saved = np.zeros(n, np.int64)
    leaves = (lens > shared).astype(np.int64)
    edge_child = np.zeros(n, bool)   # rows where an edge node of the depth below starts
    edge_row = np.zeros(n, bool)     # rows of this depth's edge nodes
    parent_of = np.full(n, -1, np.int64)
    below = None                     # final shared nodes of the depth below, waiting for their parent
    by_depth = np.argsort(shared, kind="stable")
    depths = shared[by_depth]
    idx = np.zeros(0, np.int64)
    for d in range(int(shared.max()), -1, -1):
        lo, hi = np.searchsorted(depths, [d, d + 1])
        new = np.sort(by_depth[lo:hi])
        edge_row[idx] = False
        if len(new):
            idx = np.sort(np.concatenate([idx, new]))
        head = np.flatnonzero(lcp[idx] < d)
        at = idx[head]               # rows where nodes of this depth start
        count = np.diff(np.r_[head, len(idx)])
        least = np.minimum.reduceat(convs[idx], head)
        child = ((shared[idx] > d) & (lcp[idx] <= d) & ~edge_child[idx]) | ((shared[idx] == d) & (lens[idx] > d))
        kids = np.add.reduceat(child.astype(np.int64), head)
        end = idx[head + count - 1]
        edge = (at == 0) | (end == n - 1)
        text = chars[starts[at] + d - 1] if d else np.zeros(len(at), np.int64)
        own = np.where(edge, 0, (count - 1) * text)
        s = np.add.reduceat(saved[idx], head) + own
        v = np.add.reduceat(leaves[idx], head) + (~edge & (kids == 0))
        saved[idx] = 0
        leaves[idx] = 0
        saved[at], leaves[at] = s, v
        done = np.add.reduceat((lens[idx] == d).astype(np.int64), head)
        parent_of[idx] = np.repeat(least, count)
        edge_row[idx] = np.repeat(edge, count)
        up = _Parents(parent_of, edge_row, int(count[0]) if at[0] == 0 else 0, first[d:d + 1], last[d:d + 1])
        if below is not None:
            yield _final(below, up, shard)
        yield from _chains(new[lens[new] > d], d, lens, convs, up, shard)
        hashes = np.full(len(at), EMPTY, object)
        for i in np.flatnonzero((done > 0) & ~edge):
            hashes[i] = _ends(convs[at[i]:at[i] + done[i]])
        keep = ~edge
        below = {"at": at[keep], "depth": d, "conv_id": least[keep], "n_convs": count[keep], "n_children": kids[keep],
                 "n_leaves": v[keep], "saved_tokens": s[keep], "ends": hashes[keep]}
        edge_child[idx] = False
        edge_child[at[edge]] = True
        for i in np.flatnonzero(edge):
            in_first, in_last = at[i] == 0, end[i] == n - 1
            chain = first if in_first else last
            yield {"kind": [EDGE], "shard": [shard], "paths": [int(in_first) + 2 * int(in_last)], "depth": [d],
                   "node": [chain[d]], "parent": [chain[d - 1] if d else None], "conv_id": [least[i]],
                   "parent_conv_id": [None], "n_convs": [count[i]], "n_children": [kids[i]], "n_leaves": [v[i]],
                   "saved_tokens": [s[i]], "chars": [text[i]], "ends": [None]}
            ids = convs[at[i]:at[i] + done[i]]
            for p in range(0, len(ids), PIECE):
                piece = ids[p:p + PIECE]
                yield {"kind": [ENDS], "shard": [shard], "paths": [None], "depth": [d], "node": [chain[d]],
                       "parent": [None], "conv_id": [piece[0]], "parent_conv_id": [None], "n_convs": [None],
                       "n_children": [None], "n_leaves": [None], "saved_tokens": [None], "chars": [None],
                       "ends": [",".join(map(str, piece.tolist()))]}


class _Parents:
    """Nodes of one depth as parents of what starts at given rows: the smallest
    member of a final one, the name of one that may go on in another shard."""

    def __init__(self, least: np.ndarray, edge_row: np.ndarray, run: int, first: list[bytes], last: list[bytes]):
        # The node of row 0 covers the first ``run`` rows; any other edge node is the last row's.
        self.least, self.edge_row, self.run, self.first, self.last = least, edge_row, run, first, last

    def edge(self, rows: np.ndarray) -> np.ndarray:
        return self.edge_row[rows]

    def names(self, rows: np.ndarray, edge: np.ndarray) -> list:
        return [None if not e else self.first[0] if r < self.run else self.last[0]
                for r, e in zip(rows.tolist(), edge.tolist())]


def _final(nodes: dict, up: _Parents, shard: int) -> dict:
    at, k = nodes["at"], len(nodes["at"])
    e = up.edge(at)
    return {"kind": [FINAL] * k, "shard": [shard] * k, "paths": [None] * k, "depth": [nodes["depth"]] * k,
            "node": [None] * k, "parent": up.names(at, e), "conv_id": nodes["conv_id"],
            "parent_conv_id": _masked(up.least[at], e), "n_convs": nodes["n_convs"],
            "n_children": nodes["n_children"], "n_leaves": nodes["n_leaves"], "saved_tokens": nodes["saved_tokens"],
            "chars": [None] * k, "ends": nodes["ends"]}


def _masked(values: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=null)


def _chains(rows: np.ndarray, depth: int, lens: np.ndarray, convs: np.ndarray, up: _Parents, shard: int,
            block: int = 1 << 16) -> Iterator[dict]:
    """Nodes below ``depth`` of rows that share none of them: one per turn."""
    while len(rows):
        take = max(1, int(np.searchsorted(np.cumsum(lens[rows] - depth), block)))
        part, rows = rows[:take], rows[take:]
        size = lens[part] - depth
        k = int(size.sum())
        row = np.repeat(part, size)
        d = np.arange(k) - np.repeat(np.cumsum(size) - size, size) + depth + 1
        top, leaf = d == depth + 1, d == lens[row]
        e = top & up.edge(row)
        hashes = np.full(k, EMPTY, object)
        hashes[leaf] = [_ends(convs[r:r + 1]) for r in part]
        one = np.ones(k, np.int64)
        yield {"kind": [FINAL] * k, "shard": [shard] * k, "paths": [None] * k, "depth": d, "node": [None] * k,
               "parent": up.names(row, e), "conv_id": convs[row],
               "parent_conv_id": _masked(np.where(top, up.least[row], convs[row]), e), "n_convs": one,
               "n_children": (~leaf).astype(np.int64), "n_leaves": one, "saved_tokens": one - 1, "chars": [None] * k,
               "ends": hashes}


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PARTS.split(", ")])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow_schema()
    convs, lens, blobs = [], [], []
    for b in batches:
        convs.append(b.column("conv_id").to_numpy())
        for v in b.column("turns").to_pylist():
            lens.append(len(v) // NAME.itemsize)
            blobs.append(v)
    if not lens:
        return
    names = np.frombuffer(b"".join(blobs), NAME)
    del blobs
    held, size = [], 0
    for part in shard_nodes(np.concatenate(convs), np.array(lens, np.int64), names, TaskContext.get().partitionId()):
        held.append(pa.RecordBatch.from_arrays(
            [part[f.name] if isinstance(part[f.name], pa.Array) else pa.array(part[f.name], f.type) for f in schema],
            schema=schema))
        size += held[-1].num_rows
        if size >= 1 << 15:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its pieces, which arrive in order."""
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    node, state = None, None
    for b in batches:
        out = []
        for key, text in zip(b.column("node").to_pylist(), b.column("ends").to_pylist()):
            if key != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)],
                                         schema=schema)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], schema=schema)


# ------------------------------------------------------------ the operator
def turn_names(role, text):
    """20 bytes of a turn as hexadecimal digits: digest of role and text, then
    the text's code points.  The role's length keeps the two apart."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(whole, 256), 1, 32), F.lpad(F.hex(F.length(text)), 8, "0"))


def sequences(turns: DataFrame, conv: str, at: str, name: str) -> DataFrame:
    """(conv_id, turns): every conversation's turn names as one string of bytes, in order of ``at``.
    Rows with a null ``name`` only say that the conversation is there."""
    pairs = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct(F.col(at), F.col(name)))))
    return turns.groupBy(F.col(conv).alias("conv_id")).agg(
        F.unhex(F.array_join(F.transform(pairs, lambda p: p[name]), "")).alias("turns"))


def prefix_trie(convs: DataFrame, shard_turns: int = SHARD_TURNS, small_shard: int = SMALL_SHARD) -> DataFrame:
    """Nodes of the trie of ``convs`` (conv_id, turns: a string of turn names)."""
    spark = convs.sparkSession
    ship_package(spark)
    convs = materialise(convs, "trie-conversations")
    n = convs.agg(F.coalesce(F.sum(F.length("turns")), F.lit(0))).first()[0] // NAME.itemsize
    shards = max(1, min(n // small_shard, 3 * spark.sparkContext.defaultParallelism), n // shard_turns)
    dealt = convs.repartitionByRange(int(shards), "turns", "conv_id")
    small_arrow_batches(spark)
    parts = materialise(dealt.mapInArrow(_shard, PARTS), "trie-parts")
    edges = parts.filter(F.col("kind") == EDGE)
    spans = materialise(_joined_edges(parts, edges), "trie-spans")
    final = parts.filter(F.col("kind") == FINAL)
    inner = final.filter(F.col("parent").isNull()).withColumnRenamed("ends", "ends_sha256").select(*COLUMNS)
    # Final nodes under a spanning one: its smallest member, found once per shard.
    known = (edges.select("shard", F.col("node").alias("parent"))
             .join(spans.select(F.col("node").alias("parent"), F.col("conv_id").alias("_least")), "parent"))
    under = (final.filter(F.col("parent").isNotNull()).join(known, ["shard", "parent"])
             .withColumn("parent_conv_id", F.col("_least")).withColumnRenamed("ends", "ends_sha256").select(*COLUMNS))
    least = spans.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    spanning = spans.join(least, "parent", "left").select(*COLUMNS)
    return inner.unionByName(under).unionByName(spanning)


def _joined_edges(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """Spanning nodes put together from their shards."""
    total = edges.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("_kids"), F.sum("n_leaves").alias("_leaves"),
        F.sum("saved_tokens").alias("_saved"), F.max("chars").alias("chars"))
    total = materialise(total, "trie-edges")
    kids = (total.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node"))
            .agg(F.count(F.lit(1)).alias("_more")))
    total = (total.join(kids, "node", "left")
             .withColumn("n_children", F.col("_kids") + F.coalesce("_more", F.lit(0))).drop("_kids", "_more")
             .withColumn("_own", (F.col("n_convs") - 1) * F.col("chars"))
             .withColumn("_leaf", (F.col("n_children") == 0).cast("bigint")))
    # What spanning nodes add to those above them: each node counts on one path
    # through it, and the nodes of a path that count on it are its deepest.
    path = F.explode(F.filter(F.array(F.when(F.col("paths").bitwiseAND(1) > 0, F.col("shard") * 2),
                                      F.when(F.col("paths").bitwiseAND(2) > 0, F.col("shard") * 2 + 1)),
                              lambda p: p.isNotNull()))
    paths = edges.select("node", "depth", path.alias("path"))
    owner = paths.groupBy("node").agg(F.min("path").alias("owner"))
    mine = (paths.join(owner, "node").join(total.select("node", "_own", "_leaf"), "node")
            .withColumn("_here", F.col("path") == F.col("owner")))
    up = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    adds = (mine.withColumn("_s", F.sum(F.when(F.col("_here"), F.col("_own")).otherwise(0)).over(up))
            .withColumn("_l", F.sum(F.when(F.col("_here"), F.col("_leaf")).otherwise(0)).over(up))
            .groupBy("node").agg(F.sum("_s").alias("_s"), F.sum("_l").alias("_l")))
    pieces = (parts.filter(F.col("kind") == ENDS).select("node", "conv_id", "ends").repartition("node")
              .sortWithinPartitions("node", "conv_id").select("node", "ends")
              .mapInArrow(_hash_pieces, "node binary, ends_sha256 string"))
    return (total.join(adds, "node").join(pieces, "node", "left")
            .withColumn("n_leaves", F.col("_leaves") + F.col("_l"))
            .withColumn("saved_tokens", F.col("_saved") + F.col("_s"))
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))))


# --------------------------------------------------------------- the query
def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, name) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "_role", "_text")
    return (conversations.filter(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("_role"), text.alias("_text"))
            .withColumn("place", F.row_number().over(w))
            .select("conv_id", "place", turn_names(F.col("_role"), F.col("_text")).alias("name")))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation with the first turns of another (see the contract)."""
    turns = materialise(numbered(conversations), "trie-turns")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    own = turns.withColumn("_h", head)
    # Every conversation stays, also one left without a turn.
    rest = own.select("conv_id", "place", F.when(F.col("place") > F.col("_h"), F.col("name")).alias("name"))
    firsts = (turns.filter((F.col("conv_id") % 100 == 0) & (F.col("place") <= 5))
              .select(F.col("conv_id").alias("_from"), "place", "name"))
    takers = (own.filter("place = 1").select("conv_id", "_h")
              .withColumn("_from", F.col("conv_id") - F.col("conv_id") % 100))
    taken = takers.join(firsts, "_from").filter(F.col("place") <= F.col("_h")).select("conv_id", "place", "name")
    return sequences(rest.unionByName(taken), "conv_id", "place", "name")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


# The CRC of a decimal number, byte by byte and bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda a, x: list_reduce(range(8), lambda b, i: xor(b >> 1, CASE WHEN b % 2 = 1 THEN 3988292384 ELSE 0 END), xor(a, x)),
  4294967295::BIGINT))"""

SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, crc AS h FROM (SELECT conv_id, __CRC__ % 6 AS crc FROM t)),
r AS (SELECT c.conv_id, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 WHERE t.place <= c.h
  UNION ALL SELECT c.conv_id, t.place, t.role, t.text FROM c JOIN t USING (conv_id) WHERE t.place > c.h),
s AS (SELECT c.conv_id, coalesce(x.turns, []) AS turns FROM c LEFT JOIN (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS turns FROM r GROUP BY 1) x USING (conv_id)),
p AS (SELECT conv_id, turns, unnest(generate_series(0, len(turns))) AS depth FROM s),
k AS (SELECT conv_id, depth, len(turns) = depth AS ends, turns[depth].text AS last,
  sha256(to_json(turns[1:depth])::VARCHAR) AS node, sha256(to_json(turns[1:depth - 1])::VARCHAR) AS up FROM p),
n AS (SELECT node, any_value(CASE WHEN depth > 0 THEN up END) AS up, min(conv_id) AS conv_id, any_value(depth) AS depth,
  count(*) AS n_convs, any_value(coalesce(length(last), 0)) AS chars,
  sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM k GROUP BY node),
kids AS (SELECT up AS node, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY 1),
w AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids USING (node)),
sub AS (SELECT k.node, sum((w.n_convs - 1) * w.chars) AS saved, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM w JOIN k ON k.conv_id = w.conv_id AND k.depth <= w.depth GROUP BY 1)
SELECT w.conv_id, w.depth, pn.conv_id AS parent_conv_id, w.n_convs, w.n_children, sub.leaves::BIGINT AS n_leaves,
  sub.saved::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN sub USING (node) LEFT JOIN n pn ON pn.node = w.up""".replace("__CRC__", CRC32)
