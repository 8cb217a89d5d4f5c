"""Packing into optimal length buckets.

Documents are cut into pieces of at most `CONTEXT` tokens (words between white space), so the global histogram of
piece lengths has at most CONTEXT + 1 entries whatever the corpus. A dynamic program over that
histogram finds the bucket lengths with the least padding (exactly, in integers). Within a bucket
pieces get gapless ranks without a global sort, and every `budget // bucket length` of them form a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import CHUNK, ranked, stored

CONTEXT, BUCKETS, BUDGET = 8192, 16, 65536


def token_count(text: Column) -> Column:
    """Runs of characters outside [\\x20\\x09-\\x0D]; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def optimal_buckets(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most `buckets` lengths, ascending, that give the least padding when each item is padded to the next of them.

    Dynamic program: best[k][j] is the least padded total of the j shortest lengths in k buckets. The last
    bucket's cost is linear in the length, so each layer is one sweep over a lower hull of lines. Of equal plans
    that with fewer buckets is taken.
    """
    lengths = sorted(histogram)
    if not lengths:
        return []
    seen = [0]
    for x in lengths:
        seen.append(seen[-1] + histogram[x])
    n = len(lengths)
    best: list[float | int] = [0] + [float("inf")] * n
    chosen: list[list[int]] = []
    ends = []
    for _ in range(min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, value at 0, from where
        now: list[float | int] = [float("inf")] * (n + 1)
        via = [0] * (n + 1)
        head = 0
        for j in range(1, n + 1):
            if best[j - 1] != float("inf"):
                m, c = -seen[j - 1], best[j - 1]
                while len(hull) - head >= 2 and (c - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, c, j - 1))
            x = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                now[j] = hull[head][0] * x + hull[head][1] + x * seen[j]
                via[j] = hull[head][2]
        chosen.append(via)
        ends.append(now[n])
        best = now
    k = min(range(len(ends)), key=lambda i: (ends[i], i))
    out, j = [], n
    for layer in range(k, -1, -1):
        out.append(lengths[j - 1])
        j = chosen[layer][j]
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """A row for each piece: doc_id, piece, first_token, n_tokens, bucket, bucket_len, batch, row, padding.

    bucket counts from 0 by length, batch from 0 in its bucket, row from 0 in its batch; every batch of a
    bucket but its last has budget // bucket_len rows (one, if a piece is longer than the budget).
    Null, empty and blank texts are one piece of 0 tokens. Repeated rows and rows without an id are
    packed like any other. An empty table gives an empty result. Further columns are not read.
    """
    n = count(F.col(text_col)).cast("long")
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n"))
    last = F.greatest(F.ceil(F.col("n") / context) - 1, F.lit(0).cast("long"))
    cut = cut.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    first = F.col("piece") * context
    pieces = stored(cut.select("doc_id", F.col("piece").cast("int").alias("piece"), first.alias("first_token"), F.least(F.col("n") - first, F.lit(context).cast("long")).alias("n_tokens")), "pieces")
    # at most context + 1 rows
    histogram = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    lengths = optimal_buckets(histogram, buckets) or [0]
    bucket = F.size(F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x < F.col("n_tokens")))
    dealt = pieces.withColumn("bucket", bucket).withColumn("bucket_len", F.element_at(F.array(*[F.lit(x).cast("long") for x in lengths]), F.col("bucket") + 1))
    spread = F.conv(F.substring(F.md5(F.concat_ws("-", "doc_id", "piece", "n_tokens").cast("binary")), 1, 8), 16, 10).cast("long")
    at = ranked(dealt, ["bucket"], spread, [spread, F.col("doc_id"), F.col("piece"), F.col("n_tokens")], sum(histogram.values()))
    rows = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1))), F.lit(1))
    return at.select(
        "doc_id", "piece", "first_token", "n_tokens", "bucket", "bucket_len",
        F.floor(F.col("rank") / rows).alias("batch"), F.pmod("rank", rows).cast("int").alias("row"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )


def token_batches(docs: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(bucket, batch, row, doc_id, piece, bucket_len, ids, padding): the token ids of every piece of docs, whose column ids_col holds them (see `sentencepieces.encoded`).

    Pieces, buckets and batches are those of `pack` over the numbers of tokens. A document is told by its id and tokens, so an id that
    comes with several texts has the pieces of each; rows that are equal in both are packed as often as they come. Null ids_col counts as no token.
    """
    key = F.xxhash64(id_col, ids_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"), key.alias("_text"))
    # equal rows are told apart by their number, so that each piece meets its own tokens once
    own = own.groupBy("_text", "doc_id").agg(F.any_value("ids").alias("ids"), F.count(F.lit(1)).cast("int").alias("_n")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    own = stored(own.select(F.xxhash64("_text", "doc_id", "_copy").alias("_key"), "doc_id", "ids"), "tokens")
    packed = pack(own, "_key", "ids", context, buckets, budget, F.size).withColumnRenamed("doc_id", "_piece_of")
    both = packed.join(own, F.col("_piece_of") == F.col("_key"))
    part = F.slice("ids", (F.col("first_token") + 1).cast("int"), F.col("n_tokens").cast("int"))
    return both.select("bucket", "batch", "row", "doc_id", "piece", "bucket_len", part.alias("ids"), "padding")


def oracle(context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """SQL with the rows of pack(documents): the dynamic program as a CTE a layer, every pair of lengths compared."""
    layers = "".join(
        f""",
l{k} AS (SELECT * FROM (SELECT h.j, h.x, h.seen, p.cost + h.x * (h.seen - p.seen) AS cost, list_append(p.ends, h.x) AS ends, p.j AS via
    FROM h JOIN l{k - 1} p ON p.j < h.j) QUALIFY row_number() OVER (PARTITION BY j ORDER BY cost, via DESC) = 1)"""
        for k in range(1, buckets + 1)
    )
    ends = " UNION ALL ".join(f"SELECT {k} AS k, cost, ends FROM l{k} WHERE j = (SELECT max(j) FROM h)" for k in range(1, buckets + 1))
    return f"""WITH t AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n FROM documents),
p AS (SELECT doc_id, n, unnest(range(0, greatest(CAST(ceil(n / {context}) AS BIGINT), 1))) AS piece FROM t),
d AS (SELECT doc_id, CAST(piece AS INTEGER) AS piece, piece * {context} AS first_token, least(n - piece * {context}, {context}) AS n_tokens FROM p),
h AS (SELECT x, CAST(sum(c) OVER (ORDER BY x) AS BIGINT) AS seen, row_number() OVER (ORDER BY x) AS j FROM (SELECT n_tokens AS x, count(*) AS c FROM d GROUP BY 1)),
l0 AS (SELECT 0 AS j, 0 AS x, 0 AS seen, 0 AS cost, CAST([] AS BIGINT[]) AS ends, 0 AS via){layers},
b AS (SELECT ends FROM ({ends}) ORDER BY cost, k LIMIT 1),
r AS (SELECT d.*, CAST(len(list_filter(b.ends, lambda e: e < d.n_tokens)) AS INTEGER) AS bucket, b.ends, CAST('0x' || substr(md5(concat_ws('-', doc_id, piece, n_tokens)), 1, 8) AS BIGINT) AS key FROM d, b),
m AS (SELECT *, ends[bucket + 1] AS bucket_len, row_number() OVER (PARTITION BY bucket ORDER BY key % (SELECT greatest(1, (count(*) + {CHUNK - 1}) // {CHUNK}) FROM d), key, doc_id NULLS FIRST, piece, n_tokens) - 1 AS rank FROM r)
SELECT doc_id, piece, first_token, n_tokens, bucket, bucket_len, rank // greatest({budget} // greatest(bucket_len, 1), 1) AS batch, CAST(rank % greatest({budget} // greatest(bucket_len, 1), 1) AS INTEGER) AS row, bucket_len - n_tokens AS padding FROM m"""
