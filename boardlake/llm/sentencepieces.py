"""SentencePiece (BPE with byte fallback) encoding and decoding by suffix-array matching.

Pieces have the blank mark at their front or consist of it, so a text falls into units that no piece
crosses: a run of blanks with the word after it. A batch's text, each different unit once, is
joined with separators, and its suffixes are sorted as far as the longest piece. Every piece is
looked up by binary search; its range of suffixes gives all its occurrences at once, each
an edge of the lattice. Edges are sorted by where they end and relaxed in that order, short units
side by side and long ones each on its own: a prefix's last token is the one whose edge is compatible with the last token
of the prefix before it. Nothing of a batch is kept for the next but which tokens may be neighbours.

Two tokens are compatible if merging their characters by score gives just these two. A sequence is what
the merges make of a text if and only if all neighbours in it are compatible, and each prefix has one
such sequence, so relaxing finds exactly the library's tokens in one pass from left to right.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import runs

BLANK = "▁"
_UNIT = re.compile("\n|▁+[^▁\n]*|[^▁\n]+")
#: Bytes of a batch of texts; characters of its units that are indexed at a time; characters from which a unit is long.
BATCH, AT_ONCE, LONG = 4 << 20, 500_000, 200
#: Pairs of tokens whose compatibility is remembered.
REMEMBERED = 2_000_000


def model_pieces(path: str) -> list[tuple[str, int, float]]:
    """(piece, kind, score) by id from a model file; kind 0 is a normal piece, 1 a byte, 2 a control or the unknown piece."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), 1 if m.is_byte(i) else 2 if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else 0, m.get_score(i)) for i in range(m.get_piece_size())]


class Encoder:
    """The pieces of a model, and what a task has learned of units and of neighbouring tokens."""

    def __init__(self, pieces: list[tuple[str, int, float]]) -> None:
        self.text = [p for p, _, _ in pieces]
        self.score = [s for _, _, s in pieces]
        self.id_of = {p: i for i, (p, kind, _) in enumerate(pieces) if kind == 0}
        self.byte_id = np.zeros(256, np.int32)
        for i, (p, kind, _) in enumerate(pieces):
            if kind == 1:
                self.byte_id[int(p[3:5], 16)] = i
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.id_of):
            raise ValueError("a piece crosses units: it has a blank mark behind another character, or a line break")
        self.longest = max(map(len, self.id_of), default=1)
        self.ids = np.array(list(self.id_of.values()), np.int64)
        self.sizes = np.array(list(map(len, self.id_of)), np.int64)
        #: A row of code points for each piece, with zeros behind.
        self.codes = np.zeros((len(self.id_of), self.longest), np.uint32)
        for row, p in zip(self.codes, self.id_of, strict=True):
            row[: len(p)] = list(map(ord, p))
        #: Pairs of tokens that were asked for, in order, and whether they may be neighbours.
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.alone: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging the characters by score (the highest first, of equal ones that further left) leaves."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, i: int) -> bool:
        """Whether merging the token's characters gives the token."""
        if i not in self.alone:
            self.alone[i] = len(self.merged(self.text[i])) == 1
        return self.alone[i]

    def may_follow(self, key: int) -> bool:
        """Whether two tokens, as one number (see fit), may be neighbours."""
        a, b = divmod(key, len(self.text) + 1)
        if b == 0:
            return True
        if a == 0:
            return self.whole(b - 1)
        pair = [self.text[a - 1], self.text[b - 1]]
        return self.merged("".join(pair)) == pair

    def fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the tokens may follow those before them; -1 stands for the beginning and for a character without a piece."""
        key = (before.astype(np.int64) + 1) * (len(self.text) + 1) + token + 1
        own, back = np.unique(key, return_inverse=True)
        at = np.searchsorted(self.pairs, own)
        known = np.zeros(len(own), bool)
        some = at < len(self.pairs)
        known[some] = self.pairs[at[some]] == own[some]
        out = np.zeros(len(own), bool)
        out[known] = self.fits[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = [self.may_follow(x) for x in own[new].tolist()]
            if len(self.pairs) < REMEMBERED:
                self.pairs, self.fits = np.insert(self.pairs, at[new], own[new]), np.insert(self.fits, at[new], out[new])
            else:
                self.pairs, self.fits = own[new], out[new]
        return out[back]

    def edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, token) of every occurrence of every piece in the text of code points, in which 0 separates units."""
        letters, rank = np.unique(code, return_inverse=True)
        # ranks of 16 bits while they suffice; 0 is the separator
        kind, bits = (">u2", 16) if len(letters) < 0xFFFF else (">u4", 32)
        n, reach, shift = len(code), 64 // bits, int(letters[0] != 0)
        padded = np.zeros(n + 64, np.uint64)
        padded[:n] = rank.astype(np.uint64) + np.uint64(shift)
        key = np.zeros(n, np.uint64)
        for k in range(reach):
            key = key << np.uint64(bits) | padded[k : k + n]
        order = np.argsort(key)
        while reach < self.longest:
            place = np.zeros(n + reach, np.int64)
            sorted_key = key[order]
            place[order] = np.cumsum(np.concatenate(([1], sorted_key[1:] != sorted_key[:-1])))
            key = place[:n].astype(np.uint64) * np.uint64(n + 2) + place[reach : reach + n].astype(np.uint64)
            order = np.argsort(key)
            reach *= 2
        # the beginnings of the sorted suffixes as big-endian bytes, which compare like the suffixes
        width = self.longest
        whole = f"S{width * bits // 8}"
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded.astype(kind), width)[order]).view(whole).ravel()
        at = np.minimum(np.searchsorted(letters, self.codes), len(letters) - 1)
        inside = np.arange(width) < self.sizes[:, None]
        able = np.flatnonzero(((letters[at] == self.codes) | ~inside).all(1))
        low = np.where(inside, at + shift, 0)[able].astype(kind)
        high = np.where(inside[able], low, np.iinfo(kind).max).astype(kind)
        first = np.searchsorted(keys, np.ascontiguousarray(low).view(whole).ravel(), "left")
        last = np.searchsorted(keys, np.ascontiguousarray(high).view(whole).ravel(), "right")
        count = last - first
        at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(able) else np.zeros(0, np.int64)
        return order[at], np.repeat(self.sizes[able], count), np.repeat(self.ids[able], count)

    def learn(self, units: list[str]) -> list[bytes]:
        """The tokens of each unit, as bytes of 32-bit ids."""
        joined = "\0".join(units) + "\0"
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(u) for u in units])
        begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        # a unit that is or holds the separator itself has no piece for it, and edges never cover it
        start, size, token = self.edges(code)
        owner = np.repeat(np.arange(len(units)), sizes + 1)
        covered = np.zeros(len(code), bool)
        covered[start[size == 1]] = True
        inner = np.ones(len(code), bool)
        inner[begin + sizes] = False
        bare = np.flatnonzero(~covered & inner)
        start = np.concatenate((start, bare))
        size = np.concatenate((size, np.ones(len(bare), np.int64)))
        token = np.concatenate((token, np.full(len(bare), -1)))
        end = start + size - begin[owner[start]]
        by_end = np.argsort(end)
        start, size, token, end = start[by_end], size[by_end], token[by_end], end[by_end]
        last = np.full(len(code) + 1, -2, np.int64)  # of the prefix that ends before a place of the text
        last_size = np.zeros(len(code) + 1, np.int64)
        # the place begin + length stands for the prefix of that length; a unit's separator is its last place
        last[begin] = -1
        short = sizes <= LONG
        for u in np.flatnonzero(~short):
            own = owner[start] == u
            self._relax(begin[u], sizes[u], start[own], size[own], token[own], last, last_size)
        own = short[owner[start]]
        start, size, token, end = start[own], size[own], token[own], end[own]
        cut = np.searchsorted(end, np.arange(1, sizes[short].max(initial=0) + 2))
        for p in range(len(cut) - 1):
            s, z, t = (x[cut[p] : cut[p + 1]] for x in (start, size, token))
            if len(s):
                good = self.fit(last[s], t)
                last[s[good] + z[good]] = t[good]
                last_size[s[good] + z[good]] = z[good]
        # back from each unit's end: a step for all short units at once
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, live = begin + sizes, np.flatnonzero(short & (sizes > 0))
        while len(live):
            found.append((live, last[at[live]], at[live] - last_size[at[live]]))
            if (last_size[at[live]] == 0).any():
                raise AssertionError("a prefix has no token")
            at[live] -= last_size[at[live]]
            live = live[at[live] > begin[live]]
        who, what, where = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
        order = np.lexsort((where, who))
        who, what, where = who[order], what[order], where[order]
        bounds = np.searchsorted(who, np.arange(len(units) + 1))
        bare_units = set(np.unique(who[what < 0]).tolist())
        raw, cuts = what.astype(np.int32).tobytes(), (4 * bounds).tolist()
        out = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for u in bare_units:
            out[u] = self._bytes(what[bounds[u] : bounds[u + 1]], where[bounds[u] : bounds[u + 1]], code)
        for u in np.flatnonzero(~short):
            out[u] = self._bytes(*self._back(begin[u], sizes[u], last, last_size), code)
        return out

    def _relax(self, begin: int, n: int, start: np.ndarray, size: np.ndarray, token: np.ndarray, last: np.ndarray, last_size: np.ndarray) -> None:
        """The last tokens of a long unit's prefixes, by its edges in the order of their ends."""
        end_token, end_size = [-2] * (n + 1), [0] * (n + 1)
        end_token[0] = -1
        wide, known = len(self.text) + 1, {}
        for s, z, t in zip((start - begin).tolist(), size.tolist(), token.tolist(), strict=True):
            if end_token[s] == -2:
                continue
            key = (end_token[s] + 1) * wide + t + 1
            if key not in known:
                known[key] = self.may_follow(key)
            if known[key]:
                end_token[s + z], end_size[s + z] = t, z
        last[begin : begin + n + 1], last_size[begin : begin + n + 1] = end_token, end_size

    def _back(self, begin: int, n: int, last: np.ndarray, last_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, where they begin) of a long unit."""
        tokens, steps = last[begin : begin + n + 1].tolist(), last_size[begin : begin + n + 1].tolist()
        what, where, at = [], [], n
        while at:
            if not steps[at]:
                raise AssertionError("a prefix has no token")
            what.append(tokens[at])
            at -= steps[at]
            where.append(begin + at)
        return np.array(what[::-1], np.int64), np.array(where[::-1], np.int64)

    def _bytes(self, what: np.ndarray, where: np.ndarray, code: np.ndarray) -> bytes:
        """Tokens as bytes of ids; a character without a piece becomes its UTF-8 bytes' pieces."""
        if (what >= 0).all():
            return what.astype(np.int32).tobytes()
        ids = [k for w, x in zip(what.tolist(), where.tolist(), strict=True) for k in (self.byte_id[list(chr(code[x]).encode())].tolist() if w < 0 else [w])]
        return np.array(ids, np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The tokens of each text as bytes of 32-bit ids; none for null and empty texts."""
        split = [_UNIT.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        distinct = list(dict.fromkeys(u for s in split for u in s))
        tokens: dict[str, bytes] = {}
        i = 0
        while i < len(distinct):
            j, n = i, 0
            while j < len(distinct) and (n < AT_ONCE or j == i):
                n += len(distinct[j])
                j += 1
            tokens.update(zip(distinct[i:j], self.learn(distinct[i:j]), strict=True))
            i = j
        get = tokens.__getitem__
        return [b"".join(map(get, s)) for s in split]


class Decoder:
    """The bytes of each piece."""

    def __init__(self, pieces: list[tuple[str, int, float]]) -> None:
        raw = [bytes([int(p[3:5], 16)]) if kind == 1 else b"" if kind == 2 else p.replace(BLANK, " ").encode() for p, kind, _ in pieces]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the tokens, without the blank that encoding put in front."""
        n = self.size[ids]
        places = np.repeat(self.at[ids] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(ids) else np.zeros(0, np.int64)
        return self.data[places].tobytes().removeprefix(b" ").decode(errors="replace")


_HELD: dict[int, Encoder] = {}


def _encoder(pieces: list[tuple[str, int, float]]) -> Encoder:
    """The encoder of the pieces that this Python worker holds over its tasks; one at a time."""
    key = hash(tuple(pieces))
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Encoder(pieces)
    return _HELD[key]


def encoded(docs: DataFrame, pieces: list[tuple[str, int, float]], text_col: str = "text", name: str = "ids") -> DataFrame:
    """docs with the text column replaced by its tokens (array of int; empty for null and empty texts), in one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for a, b in runs(batch.column(len(others)), BATCH):
                part = batch.slice(a, b - a)
                held = encoder.encode(part.column(len(others)).to_pylist())
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in held]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(held), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], ids], [*others, name])

    own = docs.select(*others, text_col)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != text_col)
    return own.mapInArrow(run, f"{types}, {name} array<int>")


def decoded(tokens: DataFrame, pieces: list[tuple[str, int, float]], ids_col: str = "ids", name: str = "text") -> DataFrame:
    """tokens with the ids column replaced by its text (empty for null and no ids), in one narrow pass."""
    shared = tokens.sparkSession.sparkContext.broadcast(pieces)
    others = [c for c in tokens.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column(len(others)).fill_null([]) if batch.column(len(others)).null_count else batch.column(len(others))
            flat, offsets = lists.values.to_numpy(), np.asarray(lists.offsets)
            texts = [decoder.decode(flat[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(texts, pa.string())], [*others, name])

    own = tokens.select(*others, ids_col)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != ids_col)
    return own.mapInArrow(run, f"{types}, {name} string")


def round_trip(docs: DataFrame, pieces: list[tuple[str, int, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_hash, text_crc32, round_trip for each row of docs.

    Every whole text is encoded and its tokens decoded again; ids_hash is xxhash64 of the token array,
    text_crc32 that of the decoded text, and round_trip tells whether the text came back. Null texts
    have no tokens and come back as empty texts, which counts as a round trip; so do empty texts. A text that holds
    U+2581 itself comes back with blanks there. Repeated rows and rows without an id are encoded
    like any other. An empty table gives an empty result. Further columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), F.col(text_col).alias("text"))
    tokens = encoded(own, pieces).select("doc_id", "crc", "n", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "ids")
    back = decoded(tokens, pieces)
    crc = F.crc32(F.col("text").cast("binary"))
    return back.select("doc_id", "n_tokens", "ids_hash", crc.alias("text_crc32"), ((crc == F.col("crc")) & (F.octet_length("text") == F.col("n"))).alias("round_trip"))
