"""The trie of conversation prefixes, with totals of every subtree by time-forward processing.

A node is a different sequence of first turns. It is known by its depth and the exclusive or of two 64-bit hashes of each
(place, role, text) in it, so that prefixes of one conversation can be found in many tasks: turns are dealt in ranges of
(conversation, turn), a range has its own running values, and what stands before a range comes from one row for it.

Totals go from children to parents in reverse level order: nodes are sorted by depth, deepest first (by Spark, which spills), each node
pops the messages that its children have sent to it, and sends its own to its parent, through a priority queue in
the order of the receivers that spills sorted runs (`Queue`). Shards are subtrees of at most `LIMIT` turns: they hold no
parent of another one's node. Their roots' totals, added up by parent, are messages to the nodes above, which are a
trie again and the next shards, of subtrees `RATIO` times as large, until the root is in one.

A conversation's turns, a node's members and its children may be any number: none meets in one task. Only a digest of ended
conversations is sequential by definition; it is taken from texts of `PIECE` bytes, one after the other.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, stored, tidied

#: Turns of a subtree that is one shard's; how many times as many the next level's subtrees have.
LIMIT, RATIO = 50_000, 1000
#: Messages that a queue holds in memory; sorted runs that it reads at a time; messages of a block of a run.
QUEUE, OPEN_RUNS, BLOCK = 200_000, 16, 1000
#: Bytes of a text of ids.
PIECE = 1 << 14


def _xor(a: Column | str, b: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b)


def rebuilt(conversations: DataFrame, by: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conv_id, depth, ka, kb, pa, pb, points, after of every rebuilt turn; conv_id, length of every rebuilt conversation.

    A conversation c is the first h turns of conversation c - c % by (all if fewer, none if absent) and then its own after its first h;
    h is the unsigned crc32 of c in decimal modulo heads (1: conversations stay as they are). Turns are ordered by turn, null first; turns of
    one number are ordered by their contents' hashes. A null role or text is empty. Rows without conv_id belong to no conversation.
    ka and kb name the prefix that ends at the turn, pa and pb the one before; points are the code points of the text, after
    the turns from this one to the end.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.length(text).cast("long").alias("points")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"), F.col("points")]
    dealt = stored(turns.repartitionByRange("conv_id", *order).withColumn("cell", F.spark_partition_id()), "dealt")
    of_conv = Window.partitionBy("conv_id")
    before = of_conv.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = dealt.groupBy("conv_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("own", F.sum("n").over(of_conv))
    base = F.col("conv_id") - F.col("conv_id") % by
    lengths = cells.where("before = 0").where(F.col("conv_id") % by == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    plan = cells.withColumn("base", base).join(lengths, "base", "left").withColumn("h", taken).withColumn("given", F.least("h", F.coalesce("base_turns", F.lit(0).cast("long"))))
    plan = stored(plan.withColumn("length", F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("conv_id", "cell", "before", "base", "h", "given", "length"), "plan")
    within = Window.partitionBy("conv_id", "cell").orderBy(*order)
    placed = dealt.join(plan.select("conv_id", "cell", "before", "h", "given"), ["conv_id", "cell"]).withColumn("rank", F.col("before") + F.row_number().over(within))
    placed = placed.withColumn("depth", F.when(F.col("rank") > F.col("h"), F.col("rank") - F.col("h") + F.col("given")))
    mark = lambda c, d: F.when(d.isNotNull(), F.xxhash64(d.cast("long"), F.col(c))).otherwise(F.lit(0).cast("long"))
    placed = placed.withColumns({"za": mark("a", F.col("depth")), "zb": mark("b", F.col("depth"))})
    sofar = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = stored(placed.select("conv_id", "cell", "rank", "depth", "a", "b", "za", "zb", "points", F.bit_xor("za").over(sofar).alias("la"), F.bit_xor("zb").over(sofar).alias("lb")), "placed")

    # the first turns of the conversations that others begin with: fewer than `heads` each
    first = placed.where((F.col("conv_id") % by == 0) & (F.col("rank") < heads)).select(F.col("conv_id").alias("base"), "rank", F.xxhash64("rank", "a").alias("ya"), F.xxhash64("rank", "b").alias("yb"), "points")
    along = Window.partitionBy("base").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = first.select("base", F.struct("rank", F.bit_xor("ya").over(along).alias("ka"), F.bit_xor("yb").over(along).alias("kb"), "ya", "yb", "points").alias("t"))
    first = first.groupBy("base").agg(F.array_sort(F.collect_list("t")).alias("head"))
    convs = plan.where("before = 0").select("conv_id", "base", "given", "length")
    headed = stored(convs.join(first, "base", "left").select("conv_id", "length", F.coalesce(F.slice("head", F.lit(1), F.col("given").cast("int")), F.expr("cast(array() as array<struct<rank:bigint,ka:bigint,kb:bigint,ya:bigint,yb:bigint,points:bigint>>)")).alias("head")), "headed")
    lent = headed.select("conv_id", "length", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.rank").alias("depth"), "t.ka", "t.kb", _xor(F.col("t.ka"), F.col("t.ya")).alias("pa"), _xor(F.col("t.kb"), F.col("t.yb")).alias("pb"), "t.points", (F.col("length") - F.col("t.rank") + 1).alias("after")
    )
    # what stands before a cell's own turns: the head, and the conversation's earlier cells
    ended = placed.groupBy("conv_id", "cell").agg(F.max_by(F.struct("la", "lb"), "rank").alias("x"))
    last = F.element_at("head", F.when(F.size("head") > 0, -1))
    joined = ended.join(headed.select("conv_id", "length", F.coalesce(last["ka"], F.lit(0).cast("long")).alias("ha"), F.coalesce(last["kb"], F.lit(0).cast("long")).alias("hb")), "conv_id")
    start = lambda c: _xor(F.coalesce(F.bit_xor(f"x.l{c}").over(before), F.lit(0).cast("long")), f"h{c}").alias(f"s{c}")
    starts = joined.select("conv_id", "cell", "length", start("a"), start("b"))
    mine = placed.where("depth is not null").join(starts, ["conv_id", "cell"]).withColumns({"ka": _xor("la", "sa"), "kb": _xor("lb", "sb")})
    mine = mine.select("conv_id", "depth", "ka", "kb", _xor("ka", "za").alias("pa"), _xor("kb", "zb").alias("pb"), "points", (F.col("length") - F.col("depth") + 1).alias("after"))
    return lent.unionByName(mine), headed.select("conv_id", "length")


KEY = ["depth", "ka", "kb"]


class Queue:
    """Messages (receiver, ...) in the order of their receivers.

    Beyond `most` in memory, all are written as a sorted run to a scratch file of the task, which nothing else reads and which goes with it.
    """

    def __init__(self, most: int = QUEUE) -> None:
        self.most, self.new, self.front = most, [], []
        self.spilled = 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.new, message)
        if len(self.new) > self.most:
            self._spill(sorted(self.new))
            self.new = []

    def _spill(self, messages) -> None:
        if len(self.front) >= OPEN_RUNS:  # one run of all that are open, and of the new one
            messages = heapq.merge(messages, *[self._rest(m, run) for m, _, run in self.front])
            self.front = []
        file, block = tempfile.TemporaryFile(), []
        for m in messages:
            block.append(m)
            if len(block) == BLOCK:
                pickle.dump(block, file)
                block = []
        pickle.dump(block, file)
        file.seek(0)
        self.spilled += 1
        self._open(self._read(file), self.spilled)

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while block := pickle.load(file):
                yield from block
                if len(block) < BLOCK:
                    return

    @staticmethod
    def _rest(first: tuple, run: Iterator[tuple]) -> Iterator[tuple]:
        yield first
        yield from run

    def _open(self, run: Iterator[tuple], number: int) -> None:
        first = next(run, None)
        if first is not None:
            heapq.heappush(self.front, (first, number, run))

    def of(self, receiver: tuple) -> Iterator[tuple]:
        """The messages to a receiver, which is the first that has any."""
        while True:
            if self.new and self.new[0][0] == receiver:
                yield heapq.heappop(self.new)
            elif self.front and self.front[0][0][0] == receiver:
                m, number, run = heapq.heappop(self.front)
                self._open(run, number)
                yield m
            else:
                return


TOTALS = "depth long, ka long, kb long, pa long, pb long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"


def _forward(most: int):
    """Totals of the nodes of a shard, which come deepest first and by key; a top sends nothing, as its parent is in no shard of this level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, number = Queue(most), 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("depth", "ka", "kb", "pa", "pb", "n_convs", "points", "top", "in_children", "in_leaves", "in_saved")]
            out = []
            for depth, ka, kb, pa_, pb, n, points, top, children, leaves, saved in zip(*columns, strict=True):
                saved += (n - 1) * points
                for _, _, more, also in queue.of((-depth, ka, kb)):
                    children, leaves, saved = children + 1, leaves + more, saved + also
                leaves = leaves if children else 1
                if not top:
                    number += 1
                    queue.push(((1 - depth, pa_, pb), number, leaves, saved))
                out.append((children, leaves, saved))
            sums = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("depth", "ka", "kb", "pa", "pb", "conv_id", "n_convs")], *sums, batch.column("top")], [x.split()[0] for x in TOTALS.split(", ")])

    return run


def totals(nodes: DataFrame, turns: DataFrame, limit: int = LIMIT, ratio: int = RATIO, most: int = QUEUE) -> DataFrame:
    """The nodes with their children's number, their subtree's leaves and saved tokens; turns are the rows that nodes were made of."""
    rest = nodes.withColumns({c: F.lit(0).cast("long") for c in ("in_children", "in_leaves", "in_saved")})
    done, kept = None, []
    order = [F.desc("depth"), "ka", "kb"]
    while True:
        above, low = rest.where(F.col("size") > limit), rest.where(F.col("size") <= limit)
        more = above.limit(1).count() > 0
        if more:
            # a conversation's turns in nodes above are its first ones; the node after them is the top of its shard
            reached = turns.join(above.select(*KEY), KEY).groupBy("conv_id").agg(F.max("depth").alias("reached"))
            cuts = turns.join(reached, "conv_id", "left").where(F.col("depth") == F.coalesce("reached", F.lit(0)) + 1).select("conv_id", F.col("depth").alias("cut"), F.col("ka").alias("ca"), F.col("kb").alias("cb"))
            low = low.join(cuts, "conv_id").withColumn("top", (F.col("depth") == F.col("cut")) & (F.col("ka") == F.col("ca")) & (F.col("kb") == F.col("cb")))
            low = low.repartition("ca", "cb")
        else:
            low = low.withColumn("top", F.col("depth") == 0).coalesce(1)
        now = stored(low.sortWithinPartitions(*order).mapInArrow(_forward(most), TOTALS), "totals")
        kept.append(now)
        done = now if done is None else done.unionByName(now)
        if not more:
            return done
        sent = now.where("top").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        added = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        before = rest
        rest = stored(above.join(sent, KEY, "left").select(*nodes.columns, added("in_children", "c"), added("in_leaves", "l"), added("in_saved", "s")), "above")
        forget(before)
        limit *= ratio


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, first id, text): comma-joined ids of a node, about PIECE bytes of them; rows come by node and id."""
    node, ids, size = None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in node], pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], [*KEY, "first", "text"])

    for batch in batches:
        for *own, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id")), strict=True):
            if ids and (own != node or size >= PIECE):
                yield piece()
                ids, size = [], 0
            node = own
            ids.append(conv)
            size += len(str(conv)) + 1
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, sha = None, None

    def told(nodes: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([n[k] for n, _ in nodes], pa.int64()) for k in range(3)], pa.array([s for _, s in nodes], pa.string())], [*KEY, "ends_sha256"])

    for batch in batches:
        out = []
        for *own, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text")), strict=True):
            if own != node:
                if sha:
                    out.append((node, sha.hexdigest()))
                node, sha = own, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(text.encode())
        yield told(out)
    if sha:
        yield told([(node, sha.hexdigest())])


def digests(ends: DataFrame) -> DataFrame:
    """For each node (depth, ka, kb) the SHA-256 of its conv_ids, ascending and comma-joined."""
    by = ["ka", "kb", "depth"]
    texts = ends.repartitionByRange(*by, "conv_id").sortWithinPartitions(*by, "conv_id").mapInArrow(_texts, "depth long, ka long, kb long, first long, text string")
    return texts.repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(_digests, "depth long, ka long, kb long, ends_sha256 string")


def prefixes(parts: tuple[DataFrame, DataFrame], limit: int = LIMIT, ratio: int = RATIO, most: int = QUEUE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node of the trie of `rebuilt` conversations.

    conv_id is the smallest member, parent_conv_id the parent's; the root has depth 0 and no parent. n_leaves counts childless
    nodes of the subtree, the node itself included; saved_tokens adds up (members - 1) times the code points of the last text; ends_sha256 is of
    the conversations that end at the node. Repeated rows of a turn are turns of their own. No conversation gives no node.
    """
    turns, convs = parts
    with tidied(turns.sparkSession):
        turns = stored(turns, "prefixes")
        root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.col("length") + 1).alias("size")).where("n_convs > 0")
        zero = F.lit(0).cast("long")
        root = root.select(*[zero.alias(c) for c in (*KEY, "pa", "pb")], "n_convs", "conv_id", zero.alias("points"), "size")
        below = turns.groupBy(*KEY).agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("points").alias("points"), F.sum("after").alias("size"))
        nodes = stored(below.unionByName(root), "nodes")
        found = totals(nodes, turns, limit, ratio, most)
        ends = turns.where("after = 1").select(*KEY, "conv_id").unionByName(convs.where("length = 0").select(*[zero.alias(c) for c in KEY], "conv_id"))
        parents = nodes.select((F.col("depth") + 1).alias("_d"), F.col("ka").alias("_a"), F.col("kb").alias("_b"), F.col("conv_id").alias("parent_conv_id"))
        told = found.join(digests(ends), KEY, "left").join(parents, (F.col("depth") == F.col("_d")) & (F.col("pa") == F.col("_a")) & (F.col("pb") == F.col("_b")), "left")
        nothing = F.lit(hashlib.sha256().hexdigest())
        return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


#: crc32 of a conversation's id in decimal, bit by bit: 3988292384 is its polynomial.
_CRC32 = "xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: list_reduce([xor(c, b)] || CAST(range(8) AS BIGINT[]), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))))"

ORACLE = f"""WITH t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, n, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
r AS MATERIALIZED (SELECT c.conv_id, t.n AS depth, role, text FROM c JOIN t ON t.conv_id = c.base AND t.n <= c.h
    UNION ALL SELECT c.conv_id, t.n - c.h + least(c.h, coalesce(b.n, 0)), role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.n > c.h LEFT JOIN c b ON b.conv_id = c.base),
p AS MATERIALIZED (SELECT conv_id, length(text) AS points, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
    UNION ALL SELECT conv_id, 0, CAST([] AS VARCHAR[]) FROM c),
n AS MATERIALIZED (SELECT path, min(conv_id) AS conv_id, count(*) AS n_convs, max(points) AS points FROM p GROUP BY path),
k AS MATERIALIZED (SELECT path[1:len(path) - 1] AS path, count(*) AS n_children FROM n WHERE len(path) > 0 GROUP BY 1),
u AS (SELECT n.path[1:g.d] AS path, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves, sum((n_convs - 1) * points) AS saved
    FROM n LEFT JOIN k USING (path), LATERAL (SELECT unnest(range(len(n.path) + 1)) AS d) g GROUP BY 1),
e AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS s FROM (SELECT conv_id, arg_max(path, len(path)) AS path FROM p GROUP BY conv_id) GROUP BY path)
SELECT n.conv_id, CAST(len(n.path) AS BIGINT) AS depth, CASE WHEN len(n.path) > 0 THEN o.conv_id END AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
    CAST(saved AS BIGINT) AS saved_tokens, coalesce(e.s, sha256('')) AS ends_sha256
FROM n LEFT JOIN k USING (path) JOIN u USING (path) LEFT JOIN e USING (path) LEFT JOIN n o ON o.path = n.path[1:len(n.path) - 1]"""
