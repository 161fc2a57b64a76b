"""Byte-pair encoding and decoding of whole texts, with a segment tree over the ranks of adjacent pairs.

A text is cut at the vocabulary's added tokens, then into pre-tokens, and each pre-token becomes its UTF-8 bytes as
symbols. The leaves of a segment tree hold (rank, place) of every pair of neighbours, and each inner node the smaller of
its two children; so the root is the leftmost pair of lowest rank. Merging it changes at most three leaves, each mended
on its way up in logarithmic time, until the root holds no pair. A pre-token of n bytes thus takes O(n log n), also the
one without any white space for megabytes. Merges never cross pre-tokens, so each different pre-token is merged once and
its ids are kept by the 64-bit hash of its bytes (a worker holds up to a million). Texts are split by the classes of
their code points, in arrays over whole batches: letters, numbers, others, each with one space before them; white space;
and the English contractions.

The vocabulary is a file of the ``tokenizers`` format with a byte-level BPE model. The driver reads it and broadcasts its
bytes (at most ``FILE_LIMIT``), so executors need no copy.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import fresh, table, worker_cache
from tidemill.llm.words import BASE, PIECE, STEP, _power, mix, row_ranges, text_buffer

VOCABULARY = "byte_bpe_50k.json"
FILE_LIMIT = 64 << 20
#: White space of Unicode.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, SPACE, OTHER, YOUNG = range(5)
ROWS = 256
#: Bytes of text that are encoded at once, symbols up to which pre-tokens are merged together, and how many of these.
BYTES = 1 << 20
TOGETHER, GROUP = 64, 8192
#: Slots for the hashes of known pre-tokens.
KNOWN_BITS = 21
ADDED = 0x5EED << 40
NO_PAIR = 1 << 62


def merge_lowest(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """``symbols`` after all merges, always of the leftmost pair of lowest rank.

    ``pairs`` maps (left << 32 | right) to (rank, merged symbol).
    """
    n = len(symbols)
    if n < 2:
        return symbols
    symbols, find = list(symbols), pairs.get
    bits = (n - 2).bit_length()
    width = 1 << bits
    merged = [0] * n
    tree = [NO_PAIR] * (2 * width)
    for at in range(n - 1):
        if found := find(symbols[at] << 32 | symbols[at + 1]):
            tree[width + at], merged[at] = found[0] << bits | at, found[1]
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != NO_PAIR:
        at = root & (width - 1)
        gone = after[at]
        symbols[at], symbols[gone] = merged[at], -1
        right, left = after[gone], before[at]
        after[at] = right
        changed = [(at, NO_PAIR)]
        if right < n:
            before[right] = at
            changed = [(gone, NO_PAIR), (at, NO_PAIR)]
            if found := find(symbols[at] << 32 | symbols[right]):
                changed[1], merged[at] = (at, found[0] << bits | at), found[1]
        if left >= 0:
            value = NO_PAIR
            if found := find(symbols[left] << 32 | symbols[at]):
                value, merged[left] = found[0] << bits | left, found[1]
            changed.append((left, value))
        for place, value in changed:
            node = width + place
            if tree[node] != value:
                tree[node] = value
                while node > 1:
                    other = tree[node ^ 1]
                    if other < value:
                        value = other
                    node >>= 1
                    if tree[node] == value:
                        break
                    tree[node] = value
    return [s for s in symbols if s >= 0]


class Pairs:
    """Ranks of mergeable pairs, for one lookup or for many at once."""

    def __init__(self, merges: dict[int, tuple[int, int]]):
        self.of = merges
        keys = np.fromiter(merges, np.int64, len(merges))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NO_PAIR)
        self.ranks = np.append(np.fromiter((r for r, _ in merges.values()), np.int64, len(merges))[order], 0)
        self.merged = np.zeros(len(merges), np.int64)
        for rank, symbol in merges.values():
            self.merged[rank] = symbol

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
        """(rank << bits | place) of the pairs, ``NO_PAIR`` where there is none; symbols below 0 are no symbols."""
        key = left << 32 | right
        found = np.searchsorted(self.keys, key)
        np.minimum(found, len(self.keys) - 1, out=found)
        return np.where((self.keys[found] == key) & (left >= 0) & (right >= 0), self.ranks[found] << bits | at, NO_PAIR)


def merge_many(rows: list[list[int]], pairs: Pairs) -> list[np.ndarray]:
    """``merge_lowest`` of many short symbol lists at once: one segment tree a row, merged in step."""
    if not rows:
        return []
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    bits = max(0, int(sizes.max()) - 2).bit_length()
    width = 1 << bits
    symbols = np.full((len(rows), width + 2), -1, np.int64)
    symbols[np.arange(width + 2) < sizes[:, None]] = np.fromiter((s for r in rows for s in r), np.int64, int(sizes.sum()))
    tree = np.full((len(rows), 2 * width), NO_PAIR, np.int64)
    tree[:, width:] = pairs.leaves(symbols[:, :width], symbols[:, 1:width + 1], np.arange(width), bits)
    for level in range(bits - 1, -1, -1):
        low = 1 << level
        tree[:, low:2 * low] = np.minimum(tree[:, 2 * low:4 * low:2], tree[:, 2 * low + 1:4 * low:2])
    after = np.tile(np.minimum(np.arange(1, width + 3), width + 1), (len(rows), 1))
    before = np.tile(np.arange(-1, width + 1), (len(rows), 1))
    live = np.flatnonzero(tree[:, 1] != NO_PAIR)
    while len(live):
        root = tree[live, 1]
        at, rank = root & (width - 1), root >> bits
        gone = after[live, at]
        right, left = after[live, gone], before[live, at]
        now = pairs.merged[rank]
        symbols[live, at], symbols[live, gone] = now, -1
        after[live, at], before[live, right] = right, at
        first = np.maximum(left, 0)
        tree[live, np.minimum(width + gone, 2 * width - 1)] = NO_PAIR
        tree[live, width + at] = pairs.leaves(now, symbols[live, right], at, bits)
        other = pairs.leaves(np.where(left >= 0, symbols[live, first], -1), now, first, bits)
        tree[live, width + first] = np.where(left >= 0, other, tree[live, width + first])
        for place in (gone, at, first):
            node = np.minimum(width + place, 2 * width - 1)
            for _ in range(bits):
                node >>= 1
                tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
        live = live[tree[live, 1] != NO_PAIR]
    return [r[r >= 0] for r in symbols]


class Known:
    """Ids by 64-bit hash of a pre-token's bytes: open addressing over arrays, emptied when half full."""

    def __init__(self, bits: int = KNOWN_BITS):
        self.bits, self.size = bits, 1 << bits
        self.clear()

    def clear(self) -> None:
        self.keys, self.held = np.zeros(self.size, np.uint64), 0
        self.first, self.n = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where it is not known."""
        out = np.full(len(hashes), -1, np.int64)
        slot, left = (hashes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            key = self.keys[slot]
            hit = key == hashes[left]
            out[left[hit]] = slot[hit]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + 1) & (self.size - 1)
        return out

    def add(self, hashes: np.ndarray, ids: list[np.ndarray]) -> None:
        """Different hashes that are not known yet, with their ids."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = self.used + np.cumsum(n)
        if len(ids) and ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), int(ends[-1])), np.uint32)])
        if len(ids):
            self.ids[self.used:ends[-1]] = np.concatenate(ids)
            self.used = int(ends[-1])
        self.held += len(ids)
        slot, left = (hashes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]
            placed = free & (self.keys[slot] == hashes[left])
            self.first[slot[placed]], self.n[slot[placed]] = (ends - n)[left[placed]], n[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & (self.size - 1)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes, none of them 0, of byte ranges that do not overlap and come in order."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(out):
        base = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        size = int(ends[last - 1]) - base
        power, back = _power("p", BASE, size + 1), _power("i", pow(BASE, -1, 1 << 64), size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data[base:base + size].astype(np.uint64) + np.uint64(1)) * power[:size], out=sums[1:])
        a, b = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (sums[b] - sums[a]) * back[a]
        first = last
    return np.maximum(mix(out + (ends - starts).astype(np.uint64) * np.uint64(STEP)), np.uint64(1))


class Codec:
    """Encoder and decoder of one vocabulary file over columns of texts."""

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        model, splitter = spec["model"], spec["pre_tokenizer"] or {}
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") \
                or not splitter.get("use_regex", True) or spec["normalizer"] or any(model.get(k) for k in plain) \
                or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(letters)]
        byte_of = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(others)}
        vocab: dict[str, int] = model["vocab"]
        self.symbol = [-1] * 256
        for c, b in byte_of.items():
            self.symbol[b] = vocab.get(c, -1)
        merges = (pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"])
        self.pairs = Pairs({vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)})
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(added, key=len, reverse=True))) if added else None
        self.added = [added[t] for t in sorted(added, key=len, reverse=True)]
        texts = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in [*vocab.items(), *added.items()]}
        self.length = np.zeros(max(texts) + 2, np.int64)
        for i, t in texts.items():
            self.length[i] = len(t)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(texts[i] for i in sorted(texts)), np.uint8)
        # Classes by code point; those younger than this Python's table are asked of the vocabulary's own library when met.
        kinds = {"L": LETTER, "N": NUMBER}
        self.kind = np.fromiter((YOUNG if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER)
                                 for i in range(0x110000)), np.uint8, 0x110000)
        self.kind[SPACES] = SPACE
        self.probe = Tokenizer.from_str(content.decode()).pre_tokenizer.pre_tokenize_str
        self.known = Known()

    @classmethod
    def of(cls, content) -> Codec:
        """The codec of this worker for a broadcast file, made once."""
        known = worker_cache("codecs")
        if content.value not in known:
            known[content.value] = cls(content.value)
        return known[content.value]

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kind[points]
        if (young := kinds == YOUNG).any():
            for c in np.unique(points[young]).tolist():
                alike = [k for k, p in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.probe(p + chr(c))) == 1]
                self.kind[c] = alike[0] if alike else SPACE
            kinds = self.kind[points]
        return kinds

    def starts(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin in code points of texts that begin at ``edges`` (ascending, without the end)."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        kinds = self._kinds(points)
        edge = np.zeros(n + 1, bool)
        edge[edges] = edge[n] = True
        new = edge[:n].copy()
        new[1:] |= kinds[1:] != kinds[:-1]
        run = np.flatnonzero(new)
        end = np.append(run[1:], n)
        kind = kinds[run]
        begin = new.copy()
        # White space before a text's next run gives its last character away, to that run if it is a plain space.
        spaced = (kind == SPACE) & ~edge[end]
        last = end[spaced] - 1
        begin[last] = True
        plain = last[points[last] == 0x20]
        begin[plain + 1] = False
        # An apostrophe that stands alone, without a space of its own, takes certain letters behind it.
        lone = run[(kind == OTHER) & (end - run == 1) & (points[run] == 0x27) & begin[run]]
        lone = lone[~edge[lone + 1]]
        one, two = points[lone + 1], points[np.minimum(lone + 2, n - 1)]
        two = np.where(edge[np.minimum(lone + 2, n)], 0, two)
        size = np.isin(one, [ord(c) for c in "stmd"]) * 1
        for a, b in ("re", "ve", "ll"):
            size += 2 * ((one == ord(a)) & (two == ord(b)))
        lone, size = lone[size > 0], size[size > 0]
        begin[lone + 1] = False
        after = lone + 1 + size
        begin[after[~edge[after]]] = True
        return np.flatnonzero(begin)

    def encode_column(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (UTF-8 bytes and n + 1 offsets): all ids, and where each text's begin."""
        low, high = int(offsets[0]), int(offsets[-1])
        data, offsets = data[low:high], offsets - low
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        rows = np.searchsorted(place, offsets)
        edges, cuts = np.unique(rows[:-1][rows[:-1] < len(points)]), []
        for m in self.cut.finditer(text) if self.cut else ():
            if np.searchsorted(rows, m.start(), "right") == np.searchsorted(rows, m.end(), "left"):
                cuts.append((*m.span(), m.lastindex - 1))
        if cuts:
            more = np.array([x for a, b, _ in cuts for x in (a, b) if x < len(points)])
            edges = np.union1d(edges, more)
        begin = self.starts(points, edges)
        if cuts:
            inside = np.zeros(len(points), bool)
            for a, b, _ in cuts:
                inside[a + 1:b] = True
            begin = begin[~inside[begin]]
        first, end = place[begin], place[np.append(begin[1:], len(points))]
        hashes = hashed(data, first, end)
        if cuts:
            marks = np.searchsorted(begin, [a for a, *_ in cuts])
            which = np.array([k for *_, k in cuts])
            hashes[marks] = mix(which.astype(np.uint64) + np.uint64(ADDED))
        slot = self.known.find(hashes)
        if (missing := np.flatnonzero(slot < 0)).size:
            if self.known.held + len(missing) > self.known.size // 2:
                self.known.clear()
                missing = np.arange(len(hashes))
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            ids = self._merged([data[a:b].tobytes() for a, b in zip(first[at].tolist(), end[at].tolist(), strict=True)])
            if cuts:
                number = dict(zip(marks.tolist(), which.tolist(), strict=True))
                ids = [np.array([self.added[number[i]]], np.uint32) if i in number else x for i, x in zip(at.tolist(), ids, strict=True)]
            if len(new) > self.known.size // 2:
                self.known = Known(int(4 * len(new)).bit_length())
            self.known.add(new, ids)
            slot = self.known.find(hashes)
        n, start = self.known.n[slot], self.known.first[slot]
        ends = np.cumsum(n)
        out = self.known.ids[np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.append(0, ends)[np.searchsorted(begin, rows)]

    def _merged(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pre-tokens."""
        symbols = [[s for b in p if (s := self.symbol[b]) >= 0] for p in pieces]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
        together = []
        for i in sorted(range(len(pieces)), key=lambda i: len(symbols[i])):
            if len(symbols[i]) > TOGETHER:
                out[i] = np.array(merge_lowest(symbols[i], self.pairs.of), np.uint32)
            else:
                together.append(i)
        for a in range(0, len(together), GROUP):
            some = together[a:a + GROUP]
            for i, ids in zip(some, merge_many([symbols[i] for i in some], self.pairs), strict=True):
                out[i] = ids.astype(np.uint32)
        return out

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_column(data, np.array([0, len(data)]))[0].tolist()

    def decode_column(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of ids (all of them, and n + 1 offsets). Unknown ids say nothing; bytes that are no UTF-8 become U+FFFD."""
        known = np.where((ids >= 0) & (ids < len(self.length) - 1), ids, len(self.length) - 1)
        n = self.length[known]
        ends = np.cumsum(n)
        data = self.bytes[np.repeat(self.start[known] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.append(0, ends)[offsets]
        raw = data.tobytes()
        try:
            raw.decode()
            whole = not ((data[at[at < len(data)]] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if whole:
            return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(raw)).cast(pa.string())
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())

    def decode(self, ids: list[int]) -> str:
        return self.decode_column(np.array(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary files of this installation are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _content(spark: SparkSession, path: str | None):
    with open(path or vocabulary_path(), "rb") as file:
        content = file.read(FILE_LIMIT + 1)
    if len(content) > FILE_LIMIT:
        raise ValueError(f"a vocabulary file of more than {FILE_LIMIT} bytes")
    return spark.sparkContext.broadcast(content)


def _encoded(batches, content, packed: bool):
    codec = Codec.of(content)
    for batch in batches:
        data, offsets = text_buffer(batch.column(batch.num_columns - 1))
        for a, b in row_ranges(offsets, BYTES):
            part = batch.slice(a, b - a)
            ids, at = codec.encode_column(data, offsets[a:b + 1])
            if packed:
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [
                    None, pa.py_buffer(4 * at), pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())
            else:
                column = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, column], names=[str(i) for i in range(part.num_columns + 1)])


def _decoded(batches, content, packed: bool):
    codec = Codec.of(content)
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            column = part.column(part.num_columns - 1)
            if packed:
                rows = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in column.to_pylist()]
            else:
                rows = [np.array([i for i in x or () if i is not None], np.int64) for x in column.to_pylist()]
            at = np.cumsum([0, *map(len, rows)])
            texts = codec.decode_column(np.concatenate(rows), at)
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[str(i) for i in range(part.num_columns + 1)])


def _mapped(rows: DataFrame, column: str, into: str, kind: T.DataType, function) -> DataFrame:
    """``rows`` with the result of ``function`` over ``column`` as the column ``into``, which gives way if it exists."""
    names = [c for c in rows.columns if c.lower() != into.lower()]
    extra = fresh("value", names)
    inner = rows.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{column}`").alias(extra))
    types = [*(f.dataType for f in inner.schema.fields), kind]
    out = inner.mapInArrow(function, T.StructType([T.StructField(str(i), t) for i, t in enumerate(types)]))
    return out.select(*(F.col(f"`{i}`").alias(n) for i, n in enumerate(names)), F.col(f"`{len(types) - 1}`").alias(into))


def encode(docs: DataFrame, column: str = "text", into: str = "ids", vocabulary: str | None = None,
           packed: bool = False) -> DataFrame:
    """``docs`` with the token ids of whole texts: array<int>, or little-endian 32-bit integers in a binary if ``packed``.

    Null and empty texts have no ids; strings of added tokens become these tokens; repeated rows are alike; an empty
    table gives an empty result. An existing column ``into`` gives way, others stay, whatever their names.
    """
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    return _mapped(docs, column, into, kind, partial(_encoded, content=_content(docs.sparkSession, vocabulary), packed=packed))


def decode(rows: DataFrame, column: str = "ids", into: str = "decoded", vocabulary: str | None = None,
           packed: bool = False) -> DataFrame:
    """``rows`` with the text of their ids, added tokens included. Null and no ids give the empty text; ids that the
    vocabulary lacks say nothing."""
    content = _content(rows.sparkSession, vocabulary)
    return _mapped(rows, column, into, T.StringType(), partial(_decoded, content=content, packed=packed))


def n_tokens(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ``n_tokens``, SHA-256 of its packed ids, SHA-256 of the text that they decode to. All documents, whole
    texts; a null text counts as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, packed=True).drop("text"), packed=True)
    return both.select("doc_id", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
