"""A stored full-text index: blocks of postings by token.

A row is a block: of one token in one field, the numbers of the texts that have it, as distances from the block's least, and the
places of the token in each. A block covers 2**width numbers; the width follows the token's frequency, so that a block has about `BLOCK`
texts whether the word is rare or in every text. Files hold ranges of tokens, and row groups their least and greatest token, so a
question reads the row groups of its words. Words meet text by text; of a word with more blocks than the rarest has texts only blocks that those fall in are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import versions
from .search import _ACCENTS, tokens
from .versions import settled

#: Texts of a block, about; bytes of a row group.
BLOCK, GROUP = 1024, 4 << 20
#: Bytes of texts that are listed together, about, and that are split together.
BATCH, SLICE = 64 << 20, 1 << 18
#: Frequent words that go to every task; of more, the postings are met in an equi-join.
SENT_WORDS = 200_000
#: Letters that need not become one letter each, or whose kind may depend on the version of Unicode.
_OTHER = r"[\x{130}\x{250}-\x{10FFFF}]"
#: The letter or digit that `tokens` makes of each character but those, and 0 of all that stand between words.
_FOLDED = np.array([ord(chr(c).lower()[0].translate(str.maketrans(*_ACCENTS))) if unicodedata.category(chr(c))[0] in "LN" else 0 for c in range(0x250)], np.uint16)
#: Rows of postings: a token's texts by their numbers; places twice, and one more for a text's first.
_POSTED = "token string, field string, n int, least long, most long, numbers binary, places binary"


def build(texts: DataFrame, fields: Iterable[str], number: str = "id") -> DataFrame:
    """(token, field, width, block, least, most, n, texts, offsets, places) of texts with a whole number of their own, in ranges of tokens.

    texts is how many texts have the token in the field; offsets are sorted, places are those of the token in each text, in order. Null and
    blank texts have no tokens; rows without a number are left out; of a repeated number the places of all its rows count.
    Only words of more than BLOCK texts are cut by a width that must be known before; the others' rows meet in one task, which counts them.
    """
    fields = list(fields)
    own = texts.where(F.col(number).isNotNull()).select(F.col(number).cast("long").alias("number"), *[F.col(f).cast("string").alias(f"_text{i}") for i, f in enumerate(fields)])
    repeated = own.groupBy("number").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("number")
    if repeated.isEmpty():
        posted = _listed(own, fields)
    else:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_text{i}").alias("text")) for i, f in enumerate(fields)])).alias("x")
        again = own.join(repeated, "number", "left_semi").select("number", each).select("number", "x.field", F.posexplode(tokens(F.col("x.text"))).alias("place", "token"))
        merged = again.groupBy("token", "field", "number").agg(F.array_sort(F.collect_list("place")).alias("places"))
        posted = _listed(own.join(repeated, "number", "left_anti"), fields).unionByName(merged.mapInArrow(_single, _POSTED))
    posted = settled(posted, "postings")
    low, high = posted.agg(F.min("least"), F.max("most")).first()
    most, span = BLOCK, float((high or 0) - (low or 0) + 1)
    found = posted.groupBy("token", "field").agg(F.sum("n").alias("texts")).where(F.col("texts") > most)
    width = F.greatest(F.least(F.floor(F.log2(F.lit(span) * most / F.col("texts"))), F.lit(62)), F.lit(0)).cast("int")
    widths = versions.settled(found.withColumn("width", width), "widths")
    if widths.count() <= SENT_WORDS:  # as a rule: a frequent word takes more than BLOCK texts
        widths = F.broadcast(widths)
    columns = ["token", "field", "width", "texts", "n", "numbers", "places"]
    cut = posted.join(widths, ["token", "field"]).select(*columns).mapInArrow(_cut, "token string, field string, width int, texts long, block long, least long, n int, numbers binary, places binary")
    rest = posted.join(widths, ["token", "field"], "left_anti").withColumns({"width": F.lit(None).cast("int"), "texts": F.lit(None).cast("long"), "block": F.lit(0).cast("long")})
    parts = cut.unionByName(rest.select(*cut.columns))
    together = parts.repartitionByRange("token", "field", "block").sortWithinPartitions("token", "field", "block", "least")
    blocks = partial(_blocks, most, span)
    return together.mapInArrow(blocks, "token string, field string, width int, block long, least long, most long, n int, texts long, offsets array<long>, places array<array<int>>")


def _listed(own: DataFrame, fields: list[str]) -> DataFrame:
    """Postings of rows (number, _text0, ...). Texts of Latin letters are split where they are listed, those with other letters by `tokens`."""
    each = []
    for i in range(len(fields)):
        text = F.col(f"_text{i}")
        ascii = F.is_valid_utf8(text) & (F.octet_length(text) == F.char_length(text))
        other = F.when(ascii, False).otherwise(text.rlike(_OTHER))  # broken bytes read as U+FFFD
        each += [F.when(~other, text).alias(f"_plain{i}"), F.when(other, tokens(text)).alias(f"_tokens{i}")]
    return own.select("number", *each).mapInArrow(partial(_lists, fields), _POSTED)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of rows with equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))


def _grouped(begin: np.ndarray, values: pa.Array) -> pa.ListArray:
    """values as lists that begin at given places."""
    return pa.ListArray.from_arrays(pa.array(np.append(begin, len(values)), pa.int32()), values)


def _packed(begin: np.ndarray, values: np.ndarray) -> pa.BinaryArray:
    """values as byte strings that begin at given places: Spark moves those whole, and lists value by value."""
    offsets = (np.append(begin, len(values)) * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The values of all byte strings of `_packed`."""
    found = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            found.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind))
    return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, kind), *found])


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of texts without _OTHER, as `tokens` has them, and each one's row."""
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    letters, sizes, rows, i = [], [], [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, "right")) - 1)
        raw, begin = data[ends[i] : ends[j]], ends[i:j] - ends[i]
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        if len(chars) < len(raw):
            begin = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[begin]
        letter = _FOLDED[chars]
        some = letter != 0
        new = some.copy()
        new[1:] &= ~some[:-1]
        own = begin[begin < len(some)]
        new[own] = some[own]
        start = np.flatnonzero(new)
        kept = letter[some]
        first = np.append((np.cumsum(some) - 1)[start], len(kept))
        if len(kept) and kept.max() >= 0x80:
            first = np.append(0, np.cumsum(1 + (kept >= 0x80) + (kept >= 0x800)))[first]
        letters.append(kept.astype(np.uint32).tobytes().decode("utf-32-le").encode())
        sizes.append(np.diff(first))
        rows.append((np.searchsorted(begin, start, "right") - 1 + i).astype(np.int32))
        i = j
    size = np.concatenate([np.zeros(1, np.int64), *sizes])
    return pa.StringArray.from_buffers(len(size) - 1, pa.py_buffer(np.cumsum(size).astype(np.int32)), pa.py_buffer(b"".join(letters))), np.concatenate([np.zeros(0, np.int32), *rows])


def _lists(fields: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (number, _plain0, _tokens0, ...): a batch's texts with a token are one row, in the order of their numbers, so that neither occurrences nor texts are shuffled or sorted as rows."""
    for whole in _joined(batches):
        step = max(1, -(-len(whole) // max(1, whole.nbytes // BATCH)))
        for batch in (whole.slice(k, step) for k in range(0, len(whole), step)):
            numbers = batch.column("number").to_numpy()
            if np.any(numbers[1:] < numbers[:-1]):
                order = np.argsort(numbers, kind="stable")
                batch, numbers = batch.take(pa.array(order)), numbers[order]
            for i, field in enumerate(fields):
                lists = batch.column(f"_tokens{i}")
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                for found, row in (_split(batch.column(f"_plain{i}")), (lists.flatten(), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes))):
                    if len(found):
                        yield _rows(found, row, numbers, field)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to BATCH bytes at least: the more texts are listed together, the fewer rows have a word."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BATCH:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _rows(found: pa.Array, row: np.ndarray, numbers: np.ndarray, field: str) -> pa.RecordBatch:
    """Postings of a batch's tokens, which come in the order of rows and places."""
    coded = found.dictionary_encode()
    word, first = coded.indices.to_numpy(), _starts(row)
    place = np.arange(len(row), dtype=np.int32) - np.repeat(first, np.diff(np.append(first, len(row)))).astype(np.int32)
    order = np.argsort((word & 0xFFFF).astype(np.uint16), kind="stable")  # by halves, each of which is counted and not compared
    if len(coded.dictionary) > 0x10000:
        order = order[np.argsort((word >> 16).astype(np.uint16)[order], kind="stable")]
    word, row, place = word[order], row[order], place[order] * 2
    token, text = _starts(word), _starts(word, row)
    place[text] += 1
    return _postings(coded.dictionary.take(pa.array(word[token])), pa.array([field]).take(pa.array(np.zeros(len(token), np.int32))), np.searchsorted(text, token), numbers[row[text]], token, place)


def _postings(token: pa.Array, field: pa.Array, begin: np.ndarray, numbers: np.ndarray, placed: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Rows of _POSTED, whose numbers and places begin at given places."""
    after = np.append(begin[1:], len(numbers))
    return pa.RecordBatch.from_arrays([token, field, pa.array(after - begin, pa.int32()), pa.array(numbers[begin], pa.int64()), pa.array(numbers[after - 1], pa.int64()), _packed(begin, numbers.astype(np.int64, copy=False)), _packed(placed, places)], ["token", "field", "n", "least", "most", "numbers", "places"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (token, field, number, places), each of one text."""
    for batch in batches:
        if len(batch):
            lists = batch.column("places")
            sizes = pc.list_value_length(lists).to_numpy()
            begin, places = np.cumsum(sizes) - sizes, lists.flatten().to_numpy() * 2
            places[begin] += 1
            yield _postings(batch.column("token"), batch.column("field"), np.arange(len(batch)), batch.column("number").to_numpy(), begin, places.astype(np.int32))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings with the width of their token's blocks, cut at the blocks."""
    for batch in batches:
        numbers, places = _unpacked(batch.column("numbers"), np.int64), _unpacked(batch.column("places"), np.int32)
        row = np.repeat(np.arange(len(batch)), batch.column("n").to_numpy())
        block = numbers >> batch.column("width").to_numpy().astype(np.int64)[row]
        begin = _starts(row, block)
        n = np.diff(np.append(begin, len(numbers)))
        at = pa.array(row[begin])
        own = [pa.array(block[begin], pa.int64()), pa.array(numbers[begin], pa.int64()), pa.array(n, pa.int32()), _packed(begin, numbers), _packed(np.flatnonzero(places & 1)[begin], places)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("token", "field", "width", "texts")], *own], ["token", "field", "width", "texts", "block", "least", "n", "numbers", "places"])


def _blocks(most: int, span: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of `_cut` in the order of token, field and block; the last one of a batch waits for its other rows."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held and len(rows) and _same(held[-1].slice(len(held[-1]) - 1), rows.slice(len(rows) - 1)):
            held.append(rows)  # one block still, which is not looked at again
            continue
        rows = pa.concat_tables([*held, rows]).combine_chunks()
        begin = _begins(rows)
        if len(begin):
            held = [rows.slice(begin[-1])]
            yield from _whole(rows.slice(0, begin[-1]), begin[:-1], most, span)
    if held:
        rows = pa.concat_tables(held).combine_chunks()
        yield from _whole(rows, _begins(rows), most, span)


def _same(a: pa.Table, b: pa.Table) -> bool:
    return all(a[c][0] == b[c][0] for c in ("token", "field", "block"))


def _begins(rows: pa.Table) -> np.ndarray:
    """Where the rows of each block begin."""
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        new[1:] = np.any([pc.not_equal(rows[c].slice(1), rows[c].slice(0, len(rows) - 1)).to_numpy() for c in ("token", "field", "block")], axis=0)
    return np.flatnonzero(new)


def _whole(rows: pa.Table, begin: np.ndarray, most: int, span: float) -> Iterator[pa.RecordBatch]:
    """One row for each block, its texts in the order of their numbers. Words without a width are whole here: it follows from their texts, and they are cut by it."""
    if not len(begin):
        return
    numbers, places = _unpacked(rows["numbers"], np.int64), _unpacked(rows["places"], np.int32)
    each = _grouped(np.flatnonzero(places & 1), pa.array(places >> 1))
    sizes = np.add.reduceat(rows["n"].to_numpy().astype(np.int64), begin)
    group = np.repeat(np.arange(len(begin)), sizes)
    if np.any((group[1:] == group[:-1]) & (numbers[1:] < numbers[:-1])):
        order = np.lexsort((numbers, group))
        numbers, each = numbers[order], each.take(pa.array(order))
    head = rows.take(pa.array(begin))
    own = np.clip(np.floor(np.log2(span * most / sizes)), 0, 62)
    width = pc.coalesce(head["width"], pa.array(own, pa.int32())).to_numpy().astype(np.int64)
    block = numbers >> width[group]
    first = _starts(group, block)
    of, n, least = group[first], np.diff(np.append(first, len(group))), numbers[first]
    token, field = (pa.concat_arrays(head[c].chunks).take(pa.array(of)) for c in ("token", "field"))
    texts = pc.coalesce(head["texts"], pa.array(sizes)).to_numpy()[of]
    offsets = numbers - np.repeat(least, n)
    yield pa.RecordBatch.from_arrays([
        token, field, pa.array(width[of], pa.int32()), pa.array(block[first]), pa.array(least), pa.array(numbers[first + n - 1]), pa.array(n, pa.int32()), pa.array(texts), _grouped(first, pa.array(offsets)), _grouped(first, each),
    ], ["token", "field", "width", "block", "least", "most", "n", "texts", "offsets", "places"])


def _shifted(number: Column, width: Column) -> Column:
    """number divided by 2**width, downward."""
    return F.call_function("shiftright", number, width)


def write(index: DataFrame, path: str) -> DataFrame:
    """The index as Parquet in the order of its tokens, as `build` leaves it; as many files as adaptive execution takes for its size."""
    index.write.mode("errorifexists").option("parquet.block.size", GROUP).parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def words(term: str) -> list[str]:
    """The tokens of a question, as texts have them."""
    return [t.translate(str.maketrans(*_ACCENTS)) for t in re.split(r"[^\w]+|_", term.lower()) if t]


def _of(index: DataFrame, word: str, fields: list[str] | None) -> DataFrame:
    rows = index.where(F.col("token") == word)
    return rows if fields is None else rows.where(F.col("field").isin(fields))


def _known(index: DataFrame, asked: list[str], fields: list[str] | None) -> tuple[dict[str, int], dict[str, dict[str, int]]]:
    """How many texts have each word of a question, in the field that has most, and the width of its blocks in each field."""
    rows = index.where(F.col("token").isin(sorted(set(asked))))
    rows = rows if fields is None else rows.where(F.col("field").isin(fields))
    counts, widths = dict.fromkeys(asked, 0), {w: {} for w in asked}
    for r in rows.groupBy("token", "field").agg(F.max("texts").alias("texts"), F.max("width").alias("width")).collect():
        counts[r["token"]] = max(counts[r["token"]], r["texts"])
        widths[r["token"]][r["field"]] = r["width"]
    return counts, widths


def _candidates(index: DataFrame, asked: list[str], fields: list[str] | None) -> DataFrame:
    """(number, field, starts) of texts in which the words stand next to each other, and the places at which they begin."""
    counts, widths = _known(index, asked, fields)
    order = sorted(range(len(asked)), key=lambda k: (counts[asked[k]], k))
    rarest, found = asked[order[0]], None
    for k in order:
        begin = lambda places, k=k: F.transform(places, lambda p: p - k)
        blocks = _met(index, asked[k], rarest, counts, widths, fields).select("field", "least", F.explode(F.arrays_zip("offsets", "places")).alias("x"))
        each = blocks.select((F.col("least") + F.col("x.offsets")).alias("number"), "field", begin(F.col("x.places")).alias("_starts"))
        if found is None:
            found = each.withColumnRenamed("_starts", "starts")
            continue
        both = found.join(each, ["number", "field"]).withColumn("starts", F.array_intersect("starts", "_starts"))
        found = both.where(F.size("starts") > 0).select("number", "field", "starts")
    return found


def _met(index: DataFrame, word: str, rarest: str, counts: dict[str, int], widths: dict[str, dict[str, int]], fields: list[str] | None, across: bool = False) -> DataFrame:
    """The blocks of a word; where the rarest word has fewer texts than those are, only the blocks that its texts fall in, across: in whichever field."""
    blocks = _of(index, word, fields)
    if counts[rarest] * BLOCK >= counts[word]:
        return blocks
    texts = _of(index, rarest, fields).select("field", "least", F.explode("offsets").alias("o")).select("field", (F.col("least") + F.col("o")).alias("number"))
    texts = texts.select("number", F.explode(F.array(*map(F.lit, widths[word]))).alias("field")) if across else texts
    return blocks.join(texts.select("field", _shifted(F.col("number"), _width(widths[word])).alias("block")).distinct(), ["field", "block"], "left_semi")


def _width(widths: dict[str, int]) -> Column:
    """The width of a word's blocks in the row's field; null where it is not in that field."""
    out = F.lit(None).cast("int")
    for field, width in widths.items():
        out = F.when(F.col("field") == field, width).otherwise(out)
    return out


def phrase(index: DataFrame, term: str, fields: list[str] | None = None) -> DataFrame:
    """(number): texts in which the term's words stand next to each other, in one of the fields. A term without a word has none."""
    asked = words(term)
    if not asked:
        return index.select(F.col("least").alias("number")).limit(0)
    return _candidates(index, asked, fields).select("number").distinct()


def every(index: DataFrame, term: str, fields: list[str] | None = None) -> DataFrame:
    """(number): texts that have all of the term's words, each in whichever of the fields."""
    asked = list(dict.fromkeys(words(term)))
    if not asked:
        return index.select(F.col("least").alias("number")).limit(0)
    counts, widths = _known(index, asked, fields)
    order, found = sorted(asked, key=lambda w: counts[w]), None
    for w in order:
        each = _met(index, w, order[0], counts, widths, fields, across=True).select("least", F.explode("offsets").alias("o")).select((F.col("least") + F.col("o")).alias("number"))
        found = each.distinct() if found is None else found.join(each, "number", "left_semi")
    return found
