"""MinHash near-dedup: fast similarity sketches, banding, exact verification on full shingle sets.

A document's set holds the hashes of its distinct 5-word shingles. Each set gets a sketch of
`COORDS` coordinates in rounds of hashed bin placement: round i throws every element into one
random bin with value i + v, and after COORDS such rounds a second run of rounds addresses each
bin in turn, so every coordinate fills whatever the size of the set. Coordinates of equal
minimum estimate the Jaccard similarity with the concentration of independent draws.

1. Documents of equal sets form a class; one sketch stands for a class.
2. Classes meet where all coordinates of a band agree. `plan` makes the bands as wide as it can while a
   pair at the threshold misses all of them with probability BAND_MISS at most: 32 bands of 6 rows at
   0.85, 38 of 5 at 0.80.
3. Within a bucket, sketches (a byte a coordinate) are compared breadth-first: each class that was
   reached is compared with those not reached yet. A spanning forest of the pairs with at least so many
   equal coordinates comes out, never all pairs. In a bucket of over BUCKET_CHUNK classes all are compared with the
   first; only those that are far from it meet all others, chunk by chunk. `plan` sets that number so that a pair at the
   threshold falls under it with probability ESTIMATE_MISS at most.
4. The forest's components are families. Texts of a family's classes come together (in chunks of
   a bounded number of shingles, every two chunks in a task) and are compared exactly, by
   breadth-first search over 100 * intersection >= percent * union on full sets.
5. Components of the confirmed links are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, forget, free, sieve, stored, text_batches
from .text import LOWER, SPACE, Hashed, mixed, pieces, words

COORDS, WIDTH = 192, 5
#: The probabilities that a pair at the threshold shares no band, and that its estimate is too low.
BAND_MISS, ESTIMATE_MISS = 3e-7, 2e-7
#: Classes of a bucket, and shingles of a family, that one side of a comparing task holds.
BUCKET_CHUNK, FAMILY_CHUNK = 1024, 300_000
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0xA0761D6478BD642F)


def plan(percent: int) -> tuple[int, int, int]:
    """(bands, rows of a band, equal coordinates that a candidate has at least) for a threshold.

    Refused (ValueError) where COORDS coordinates cannot keep BAND_MISS, which is under 8 percent.
    """
    j = percent / 100
    fit = [r for r in range(1, 9) if 0 < j <= 1 and (1 - j**r) ** (COORDS // r) <= BAND_MISS]
    if not fit:
        raise ValueError(f"no bands of {COORDS} coordinates find pairs at {percent} percent")
    least, under = 0, (1 - j) ** COORDS
    while least < COORDS and under <= ESTIMATE_MISS:
        least += 1
        under += math.comb(COORDS, least) * j**least * (1 - j) ** (COORDS - least)
    return COORDS // fit[-1], fit[-1], least


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for null and for text without words.

    Words are runs of bytes outside [\\x20\\x09-\\x0D] after A-Z are lower-cased. A text of fewer
    words than width has its whole sequence as its one shingle.
    """
    mult = mixed(np.arange(11, 11 + width, dtype=np.uint64) * _STEP) | np.uint64(1)
    for i, j, offsets, data in pieces(column):
        low = LOWER[data]
        begin, end, row = words(~SPACE[low], offsets)
        h = Hashed(low).of(begin, end) if len(begin) else np.zeros(0, np.uint64)
        firsts = np.searchsorted(row, np.arange(j - i + 1), "left")
        n = len(h) - width + 1
        s = np.zeros(max(n, 0), np.uint64)
        for k in range(width):
            s += h[k : k + n] * mult[k] if n > 0 else 0
        s = mixed(s)
        for d in range(j - i):
            a, b = firsts[d], firsts[d + 1]
            if b - a >= width:
                x = np.sort(s[a : b - width + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif b > a:
                part = np.add.reduce(h[a:b] * mult[: b - a]) + np.uint64(b - a)
                yield mixed(np.array([part], np.uint64))
            else:
                yield s[:0]


def _round(i: int) -> np.uint64:
    return np.uint64((i + 1) * int(_STEP) & int(_FULL))


def sketches(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """A row of coordinates for each nonempty set: fast similarity sketching."""
    sizes = np.array([len(s) for s in sets])
    out = np.full(len(sets) * coords, _FULL, np.uint64)
    live = np.flatnonzero(sizes)
    i = 0
    while len(live) and i < coords:
        x = np.concatenate([sets[d] for d in live])
        home = np.repeat(live, sizes[live]) * coords
        for _ in range(max(1, min(coords - i, 100_000 // len(x)))):
            h = mixed(x + _round(i))
            slot = ((h >> np.uint64(32)) * np.uint64(coords) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(out, home + slot, np.uint64(i << 32) | (h & np.uint64(0xFFFFFFFF)))
            i += 1
        live = live[(out.reshape(-1, coords)[live] == _FULL).any(1)]
    table = out.reshape(-1, coords)
    for d in live:
        for b in np.flatnonzero(table[d] == _FULL):
            h = mixed(sets[d] + _round(coords + int(b)))
            table[d, b] = np.uint64((coords + int(b)) << 32) | (h & np.uint64(0xFFFFFFFF)).min()
    return table


def _sketched(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = mixed(np.arange(101, 101 + rows, dtype=np.uint64) * _STEP) | np.uint64(1)
        names = ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch", "t"]
        for batch in batches:
            ids, done = batch.column(0), 0
            held: list[np.ndarray] = []
            for last, s in enumerate(shingle_sets(batch.column(1)), 1):
                held.append(s)
                if last < batch.num_rows and len(held) < 256:
                    continue
                table = sketches(held)
                keys = (table[:, : bands * rows].reshape(-1, bands, rows) * mult).sum(2, dtype=np.uint64)
                keys = mixed(keys + np.arange(1, bands + 1, dtype=np.uint64) * _STEP)
                small = (mixed(table) >> np.uint64(56)).astype(np.uint8)
                sums = np.array([[np.add.reduce(mixed(x + _STEP)), np.add.reduce(mixed(x ^ _STEP))] for x in held], np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(done, len(held)),
                        pa.array([len(x) for x in held], pa.int64()),
                        pa.array(sums[:, 0].view(np.int64)),
                        pa.array(sums[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(0, len(held) * bands + 1, bands, dtype=np.int32), pa.array(keys.view(np.int64).ravel())),
                        pa.array([x.tobytes() for x in small], pa.binary()),
                        batch.column(2).slice(done, len(held)),
                    ],
                    names,
                )
                done += len(held)
                held = []

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables that cut no group of the first `keys` columns, by which the batches are sorted."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        if not now.num_rows:
            continue
        same = np.ones(now.num_rows, bool)
        for k in range(keys):
            c = now.column(k).to_numpy()
            same &= c == c[-1]
        cut = int(np.argmax(same))
        if cut:
            yield now.slice(0, cut)
        held = now.slice(cut)
    if held is not None and held.num_rows:
        yield held


def starts(table: pa.Table, keys: int) -> np.ndarray:
    """Where each group begins, and the number of rows."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for k in range(keys):
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def forest(n: int, linked) -> Iterator[tuple[int, int]]:
    """(reached, from which) for a spanning forest of n members; linked(a, others) -> mask over others."""
    rest = np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            a = queue.pop()
            hit = linked(a, rest)
            for b in rest[hit]:
                yield int(b), a
                queue.append(int(b))
            rest = rest[~hit]


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _alike(least: int):
    """Spanning forest of each bucket's classes by the equal coordinates of their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            at = starts(table, 3)
            ids = table.column(3).to_numpy()
            sk = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint8).reshape(-1, COORDS)
            first = np.repeat(at[:-1], np.diff(at))
            near = np.empty(len(ids), bool)
            for i in range(0, len(ids), 4096):
                near[i : i + 4096] = (sk[i : i + 4096] == sk[first[i : i + 4096]]).sum(1) >= least
            odd = np.add.reduceat(~near, at[:-1])
            plain = near & (np.repeat(odd, np.diff(at)) == 0) & (ids != ids[first])
            a, b = ids[plain].tolist(), ids[first[plain]].tolist()
            for g in np.flatnonzero((odd > 0) & (np.diff(at) > 2)):
                part, own = sk[at[g] : at[g + 1]], ids[at[g] : at[g + 1]]
                for x, y in forest(len(own), lambda k, rest, part=part: (part[rest] == part[k]).sum(1) >= least):
                    a.append(own[x])
                    b.append(own[y])
            if a:
                yield _edges(a, b)

    return run


def exact_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets], np.int64)

    def linked(k: int, rest: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rest), bool)
        big, small = np.maximum(sizes[rest], sizes[k]), np.minimum(sizes[rest], sizes[k])
        able = np.flatnonzero((100 * small >= percent * big) & (small > 0))
        if len(able):
            some = rest[able]
            x = np.concatenate([sets[r] for r in some])
            at = np.minimum(np.searchsorted(sets[k], x), sizes[k] - 1)
            both = np.add.reduceat((sets[k][at] == x).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[some])[:-1])))
            out[able] = 100 * both >= percent * (sizes[some] + sizes[k] - both)
        return out

    for x, y in forest(len(ids), linked):
        yield ids[x], ids[y]


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            at = starts(table, 3)
            ids, marks = table.column(3).to_numpy(), table.column(4).to_numpy()
            a: list = []
            b: list = []
            texts = table.column(5)
            for g in range(len(at) - 1):
                sets = list(shingle_sets(texts.slice(at[g], at[g + 1] - at[g])))
                own = ids[at[g] : at[g + 1]]
                # a doc_id with several texts: only the text whose class it stands for counts
                keep = [k for k, s in enumerate(sets) if np.add.reduce(mixed(s + _STEP)).view(np.int64) == marks[at[g] + k]]
                for x, y in exact_links(own[keep], [sets[k] for k in keep], percent):
                    a.append(x)
                    b.append(y)
            if a:
                yield _edges(a, b)

    return run


def _paired(df: DataFrame, key: str, chunks: str, of: str) -> DataFrame:
    """Each row once for every task in which its chunk of the group meets another chunk (or itself, if there is one)."""
    mine = F.pmod(F.xxhash64(F.col(of), F.lit(7)), F.col(chunks))
    others = F.when(F.col(chunks) == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col(chunks) - 1), lambda j: j != mine))
    return df.withColumn("_o", F.explode(others)).withColumn("lo", F.least("_o", mine)).withColumn("hi", F.greatest("_o", mine)).drop("_o")


def _near_lead(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDS) for c in ("sketch", "lead_sketch"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "rep", "lead", "c")], pa.array((a == b).sum(1) >= least)], ["key", "rep", "lead", "c", "near"])

    return run


def _led(bands: DataFrame, hot: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """(key, rep, lead, c, near), stored: the classes of hot buckets, and whether each is near its bucket's first. A hot bucket's rows are split by adaptive execution."""
    leads = stored(hot.join(classes.select(F.col("rep").alias("lead"), F.col("sketch").alias("lead_sketch")), "lead"), "leads")
    own = bands.join(leads.select("key", "c", "lead", "lead_sketch"), "key").join(classes.select("rep", "sketch"), "rep")
    found = stored(own.select("key", "rep", "lead", "c", "sketch", "lead_sketch").mapInArrow(_near_lead(least), "key long, rep long, lead long, c long, near boolean"), "led")
    forget(leads)
    return found


def _odd_ones(led: DataFrame) -> DataFrame:
    """(key, lo, hi, rep): tasks in which the classes of a hot bucket that are far from its first meet all of the bucket.

    Those near the first are one family whatever else they are near, so they need not meet each other. A task has a chunk of the far ones (lo)
    and a chunk of all (hi), so rows grow as the bucket times its chunks of far ones, and the far ones times the bucket's chunks: in
    proportion, where few are far, as in a family of copies.
    """
    odd = led.where("not near").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BUCKET_CHUNK).alias("odds"))
    both = led.join(odd, "key").withColumn("chunks", F.ceil(F.col("c") / BUCKET_CHUNK))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    far = both.where("not near").withColumn("lo", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("odds"))).withColumn("hi", F.explode(upto("chunks")))
    whole = both.withColumn("hi", F.pmod(F.xxhash64("rep", F.lit(13)), F.col("chunks"))).withColumn("lo", F.explode(upto("odds")))
    return far.select("key", "lo", "hi", "rep").unionByName(whole.select("key", "lo", "hi", "rep")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Groups of documents whose sets have 100 * intersection >= percent * union, directly or by way of others.

    Returns doc_id, n_shingles, component_id (smallest doc_id of the group), kept
    (doc_id = component_id), one row for each row of docs. Columns of docs beyond the two
    named are not read, so their names cannot clash. Null and blank texts have the empty set,
    link with nothing and form a group each. A repeated row is a copy and gets the same values;
    if one doc_id comes with several texts, each text's row is judged as its own copy of that id.
    Rows without an id keep their n_shingles, have no component and are not kept. An empty
    table gives an empty result. A pair at the threshold is missed with probability BAND_MISS + ESTIMATE_MISS
    at most (see `plan`), whatever the threshold.
    """
    return _judged(docs, id_col, text_col, percent)[0].drop("t")


def _judged(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """near_duplicates with t, a hash of each row's text; and the stored tables that it reads."""
    n_bands, n_rows, least = plan(percent)
    text_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = own.withColumn("t", F.xxhash64("text")).mapInArrow(_sketched(n_bands, n_rows), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch binary, t long")
    sketched = stored(sketched, "sketches")
    classes = stored(
        sketched.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    bands = classes.select("rep", F.explode("bands").alias("key"))
    full = stored(bands.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("lead")).where("c > 1"), "buckets")
    zero = F.lit(0).cast("long")
    met = bands.join(full.where(F.col("c") <= BUCKET_CHUNK).select("key"), "key").select("key", zero.alias("lo"), zero.alias("hi"), "rep")
    hot, edges, led = full.where(F.col("c") > BUCKET_CHUNK), None, None
    if not hot.isEmpty():
        led = _led(bands, hot, classes, least)
        edges = led.where("near and rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b"))
        met = met.unionByName(_odd_ones(led))
    met = met.join(classes.select("rep", "sketch"), "rep").select("key", "lo", "hi", "rep", "sketch")
    alike = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_alike(least), "a long, b long")
    alike = (alike if edges is None else alike.unionByName(edges)).distinct()
    family = components(alike).join(classes.select(F.col("rep").alias("node"), "n", "f1"), "node")
    family = stored(family, "families")
    for table in (full, led):
        if table is not None:
            forget(table)
    sizes = family.groupBy("component").agg(F.ceil(F.sum("n") / FAMILY_CHUNK).alias("chunks"))
    tasks = _paired(family.join(sizes, "component"), "component", "chunks", "node").select("component", "lo", "hi", F.col("node").alias("doc_id"), "f1")
    # only texts of families are shuffled, and a text that its id repeats goes once
    some = own.where(sieve(family, "node")(F.col("doc_id"))).groupBy("doc_id", F.xxhash64("text").alias("_t")).agg(F.first("text").alias("text"))
    texts = tasks.join(some, "doc_id").select("component", "lo", "hi", "doc_id", "f1", "text")
    links = texts.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(_confirmed(percent), "a long, b long").distinct()
    groups = components(links)
    forget(family)
    of_class = (
        classes.select("f1", "f2", "rep").join(groups, F.col("rep") == F.col("node"), "left")
        .select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.coalesce("component", "rep").alias("class_id"))
    )
    found = sketched.select("doc_id", "n_shingles", "f1", "f2", "t").join(of_class, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    group = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    group = F.when(F.col("doc_id").isNotNull(), group)
    return found.select("doc_id", "n_shingles", group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(False)).alias("kept"), "t"), [sketched, classes]


def first_of_each(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: one of its smallest doc_id. Rows without an id all stay.

    An id that comes with several texts keeps one row of each of those that are kept. Null and blank texts are groups of
    their own and stay. An empty table gives an empty result, and all columns stay as they are. Only documents that go, or
    whose id is repeated, and those few that the sieve takes for them are shuffled.
    """
    ident, mark, stays = free(docs, "judged_id"), free(docs, "judged_text"), free(docs, "judged_kept")
    judged, read = _judged(docs, id_col, text_col, percent)
    found = judged.where("doc_id is not null").groupBy("doc_id", "t").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    found = stored(found.where("n > 1 or not kept").select(F.col("doc_id").alias(ident), F.col("t").alias(mark), F.col("kept").alias(stays)), "judged")
    for table in read:
        forget(table)
    maybe = F.col(id_col).isNotNull() & sieve(found, ident)(F.col(id_col).cast("long"))
    text = free(docs, "judged_hash")
    doubtful = docs.where(maybe).withColumn(text, F.xxhash64(text_col)).join(found, (F.col(id_col) == F.col(ident)) & (F.col(text) == F.col(mark)), "left")
    doubtful = doubtful.where(F.coalesce(F.col(stays), F.lit(True))).dropDuplicates([id_col, text]).drop(ident, mark, stays, text)
    return docs.where(~maybe).unionByName(doubtful)
