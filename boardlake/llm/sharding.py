"""Sharding by balanced label propagation.

Documents of equal text are linked through their text's digest, never as pairs. A group's
documents are dealt to blocks of a bounded number of rows, which move as one. Each round, by joins and
aggregates over blocks: a group's blocks vote with their rows for the shards that are not full;
blocks elsewhere want to go to the shard with the most votes; where more rows want in than the
shard's quota has room for, a block goes with the probability 0.9 * room / demand (a hash of block and
round decides), as no shard may take more than it has room for. Blocks in full shards stay. Rounds
end when (almost) nothing moves.

At last sizes are made even to the row: a shard keeps linked rows up to its quota, block by
block; what lies beyond and all documents without a link fill the gaps in the order of gapless ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, ranked, stored

SHARDS, BLOCK = 40, 200
#: Of a shard's room, what a round may fill on average; the dice must not overfill it.
MARGIN = 0.9


def _moved(blocks: DataFrame, room: list[int], quota: list[int], turn: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (g, k, w, s) after one round, and the stored table that they read; room: rows that each shard may still take. A shard is full from seven eighths of its quota on."""
    room = [r if r * 8 > q else 0 for r, q in zip(room, quota, strict=True)]
    left = F.array(*[F.lit(max(0, r)).cast("long") for r in room])
    open_now = F.element_at(left, F.col("s") + 1) > 0
    votes = blocks.where(open_now).groupBy("g", "s").agg(F.sum("w").alias("v"))
    # the most votes; of equal ones the shard with more room, then the smaller
    best = votes.groupBy("g").agg(F.max(F.struct("v", F.element_at(left, F.col("s") + 1).alias("r"), (-F.col("s")).alias("n"))).alias("b")).select(F.col("g").alias("_g"), (-F.col("b.n")).alias("t"))
    want = stored(blocks.join(best, F.col("g") == F.col("_g"), "left").select("g", "k", "w", "s", F.when(open_now & (F.col("t") != F.col("s")), F.col("t")).alias("t")), "wanted")
    demand = {r["t"]: r["d"] for r in want.where("t is not null").groupBy("t").agg(F.sum("w").alias("d")).collect()}
    share = F.array(*[F.lit(min(1.0, MARGIN * room[s] / demand[s]) if demand.get(s) else 0.0) for s in range(len(room))])
    dice = F.pmod(F.xxhash64("g", "k", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
    goes = F.col("t").isNotNull() & (dice < F.element_at(share, F.col("t") + 1))
    return want.select("g", "k", "w", F.when(goes, F.col("t")).otherwise(F.col("s")).alias("s"), goes.alias("went")), want


def propagate(blocks: DataFrame, quota: list[int]) -> DataFrame:
    """Blocks (g, k, w, s) with the shards that label propagation under the quotas gives.

    A group fills about one shard a round, so even a group of all rows has settled when each shard had its round.
    """
    now = stored(blocks, "blocks")
    total = sum(quota)
    for turn in range(max(12, len(quota))):
        load = {r["s"]: r["n"] for r in now.groupBy("s").agg(F.sum("w").alias("n")).collect()}
        moved, want = _moved(now, [q - load.get(s, 0) for s, q in enumerate(quota)], quota, turn)
        then = stored(moved, "blocks")
        forget(want)
        went = then.where("went").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        forget(now)
        now = then
        if went * 1000 <= total * 0.5:
            break
    return now.select("g", "k", "w", "s")


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs, by the law `rows`.

    The shards' row counts differ by one at most; slots are gapless from 0 in each shard. size is the
    text's UTF-8 bytes (null: none) plus 16; text_crc32 is null for null. Equal texts (empty
    ones too) are linked, null texts are not. Repeated rows are documents of their own. An empty table
    gives an empty result. Further columns are not read.
    """
    text = F.col(text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("g"))
    # a number of each row, so that rows of one id, or of none, fall into different blocks; it is fixed once it is stored
    own = stored(own.withColumn("u", F.monotonically_increasing_id()), "texts")
    n = own.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    size = max(1, min(BLOCK, n // shards // 16))  # small against a quota, so that blocks fill shards evenly
    groups = own.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("g").alias("_g"), F.ceil(F.col("c") / size).alias("blocks"))
    groups = stored(groups, "groups")  # a table of its own, so that the join below can split a hot group
    block = F.pmod(F.xxhash64("doc_id", "u"), F.col("blocks"))
    rows = stored(own.join(groups, F.col("g") == F.col("_g"), "left").select("doc_id", "u", "size", "text_crc32", F.when(F.col("blocks").isNotNull(), F.col("g")).alias("g"), block.alias("k")), "linked")
    blocks = rows.where("g is not null").groupBy("g", "k").agg(F.count(F.lit(1)).alias("w")).withColumn("s", F.pmod(F.xxhash64("g", "k"), F.lit(shards)).cast("int"))
    blocks = propagate(blocks, quota).select(F.col("g").alias("_g"), F.col("k").alias("_k"), "s")
    linked = rows.where("g is not null").join(blocks, (F.col("g") == F.col("_g")) & (F.col("k") == F.col("_k"))).select("doc_id", "u", "size", "text_crc32", "g", "k", "s")
    placed = stored(ranked(linked, ["s"], F.xxhash64("g", "k"), [F.col("g"), F.col("k"), F.col("doc_id"), F.col("u")], n), "placed")
    load = {r["s"]: r["n"] for r in placed.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = [min(q, load.get(s, 0)) for s, q in enumerate(quota)]
    within = F.col("rank") < F.element_at(F.array(*[F.lit(x).cast("long") for x in quota]), F.col("s") + 1)
    stay = placed.where(within).select("doc_id", "size", "text_crc32", F.col("s").alias("shard"), F.col("rank").alias("slot"))
    rest = rows.where("g is null").select("doc_id", "u", "size", "text_crc32").unionByName(placed.where(~within).select("doc_id", "u", "size", "text_crc32"))
    filler = ranked(rest.withColumn("_all", F.lit(0)), ["_all"], F.xxhash64("doc_id", "u"), [F.col("doc_id"), F.col("u")], n)
    ends, at = [], 0
    for q, k in zip(quota, kept, strict=True):
        at += q - k
        ends.append(at)
    shard = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in ends]), lambda e: e <= F.col("rank")))
    offset = F.array(*[F.lit(k - (e - (q - k))).cast("long") for q, k, e in zip(quota, kept, ends, strict=True)])
    filled = filler.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "shard", (F.col("rank") + F.element_at(offset, F.col("shard") + 1)).alias("slot"))
    both = stay.unionByName(filled)
    return both.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_edges(docs: DataFrame, group: list[str], shard: str = "shard") -> DataFrame:
    """(edges, cut): pairs of linked rows, and those whose rows lie in different shards, from counts alone.

    Rows are linked where all `group` columns are equal and not null. One row, with 0 and 0 for an empty table.
    """
    linked = docs.dropna(subset=group).groupBy(*group, shard).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("c"))
    pairs = lambda c: c * (c - 1) / 2
    per = linked.groupBy(*group).agg(F.sum("c").alias("all"), F.sum(pairs(F.col("c"))).alias("inside"))
    zero = F.lit(0).cast("long")
    edges, inside = F.sum(pairs(F.col("all"))).cast("long"), F.sum("inside").cast("long")
    return per.agg(F.coalesce(edges, zero).alias("edges"), F.coalesce(edges - inside, zero).alias("cut"))
