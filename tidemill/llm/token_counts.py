"""Edit-aware token counts: a tree over the pre-tokens of each document, of which an edit re-encodes only what it touches.

A byte-pair vocabulary never merges across pre-tokens, so a count is a sum over pre-tokens. The tree's leaves are runs of
pre-tokens (characters and tokens of each); its inner nodes hold the sums. An edit walks down to the place it changes,
goes back one pre-token more for the context that the splitting pattern looks at, and splits again from there until a
new boundary falls on an old one behind the edit. From that place on the pattern sees the same text, so the rest
stands. Only the new pre-tokens are encoded, and the sums on the way up are mended.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's text is split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
CACHE = 500_000
EDIT = "array<struct<start:long,removed:long,inserted:string>>"

_loaded: dict[tuple[str, str], Vocabulary] = {}


class Vocabulary:
    """Splits text and counts the tokens of a pre-token; remembers the counts of up to ``CACHE`` pre-tokens."""

    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, ranks: str, pattern: str) -> Vocabulary:
        """The vocabulary of this worker, read once."""
        if (ranks, pattern) not in _loaded:
            _loaded[ranks, pattern] = cls(ranks, pattern)
        return _loaded[ranks, pattern]

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encode(piece))
            if len(self.known) >= CACHE:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def split(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of every pre-token."""
        pieces = self.pattern.findall(text)
        return list(map(len, pieces)), list(map(self.count, pieces))


class CountTree:
    """Pre-tokens of a text in leaves under a binary tree of sums."""

    def __init__(self, lengths: list[int], counts: list[int], leaf: int = LEAF):
        self.leaf = leaf
        self._plant([(lengths[i:i + leaf], counts[i:i + leaf]) for i in range(0, len(lengths), leaf)] or [([], [])])

    def _plant(self, leaves: list[tuple[list[int], list[int]]]) -> None:
        self.leaves, self.width = leaves, 1 << (len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (lengths, counts) in enumerate(leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(lengths), sum(counts)
        for i in range(self.width - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def flat(self) -> tuple[list[int], list[int]]:
        return [x for a, _ in self.leaves for x in a], [x for _, b in self.leaves for x in b]

    def locate(self, char: int) -> tuple[int, int, int]:
        """Leaf, place in it, and first character of the pre-token that holds ``char`` (or of the end)."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if char - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        leaf = min(node - self.width, len(self.leaves) - 1)
        for place, n in enumerate(self.leaves[leaf][0]):
            if char < before + n:
                return leaf, place, before
            before += n
        return leaf, len(self.leaves[leaf][0]), before

    def back(self, leaf: int, place: int, start: int) -> tuple[int, int, int]:
        """The pre-token before, or the same place at the beginning."""
        while place == 0:
            if leaf == 0:
                return 0, 0, start
            leaf -= 1
            place = len(self.leaves[leaf][0])
        return leaf, place - 1, start - self.leaves[leaf][0][place - 1]

    def walk(self, leaf: int, place: int) -> Iterator[tuple[int, int, int]]:
        """(leaf, place after it, length) of each pre-token from there on."""
        for i in range(leaf, len(self.leaves)):
            lengths = self.leaves[i][0]
            for k in range(place if i == leaf else 0, len(lengths)):
                yield i, k + 1, lengths[k]

    def replace(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Put other pre-tokens in place of those from ``first`` up to before ``last`` and mend the sums."""
        (a, i), (b, j) = first, last
        (la, ca), (lb, cb) = self.leaves[a], self.leaves[b]
        self.leaves[a] = la[:i] + lengths + lb[j:], ca[:i] + counts + cb[j:]
        for k in range(a + 1, b + 1):
            self.leaves[k] = [], []
        if len(self.leaves[a][0]) > 4 * self.leaf:
            self.__init__(*self.flat(), self.leaf)
            return
        nodes = set()
        for k in range(a, b + 1):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(self.leaves[k][0]), sum(self.leaves[k][1])
            nodes.add((self.width + k) // 2)
        while nodes := nodes - {0}:
            for i in nodes:
                self._add(i)
            nodes = {i // 2 for i in nodes}


def edit(text: str, tree: CountTree, words: Vocabulary, start: int, removed: int, inserted: str) -> tuple[str, int]:
    """The text after the edit and the number of pre-tokens encoded for it; ``tree`` follows. Places beyond the text are
    taken back to its end."""
    start = min(max(0, start), len(text))
    removed = min(max(0, removed), len(text) - start)
    after = text[:start] + inserted + text[start + removed:]
    shift, behind = len(inserted) - removed, start + len(inserted)
    leaf, place, at = tree.back(*tree.locate(max(0, start - 1)))
    lengths, counts, end = [], [], (leaf, place)
    old, rest, now = at, tree.walk(leaf, place), at
    while True:
        if now >= behind:
            while old < now - shift and (step := next(rest, None)):
                end, old = step[:2], old + step[2]
            if old == now - shift and old >= start + removed:
                break
        piece = words.pattern.match(after, now).group()
        lengths.append(len(piece))
        counts.append(words.count(piece))
        now += len(piece)
    tree.replace((leaf, place), end, lengths, counts)
    return after, len(lengths)


def _lists(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(
        (x for r in rows for x in r), np.int32, int(ends[-1]))))


def _built(batches, at: int, ranks: str, pattern: str):
    words = Vocabulary.of(ranks, pattern)
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            lengths, counts = zip(*(words.split(x.as_py() or "") for x in part.column(at)), strict=True)
            yield pa.RecordBatch.from_arrays([*part.columns, _lists(lengths), _lists(counts)],
                                             names=[str(i) for i in range(part.num_columns + 2)])


def build(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with the leaves of its trees: ``lengths`` (characters) and ``counts`` (tokens) of the pre-tokens of ``text``.

    Null and empty texts have none; repeated rows are alike; an empty table gives an empty result. Columns named lengths
    or counts give way to the results. Written to a table, this is what later edits start from.
    """
    docs = docs.drop("lengths", "counts")
    at = [c.lower() for c in docs.columns].index("text")
    ints = T.ArrayType(T.IntegerType())
    types = [f.dataType for f in docs.schema.fields] + [ints, ints]
    inner = T.StructType([T.StructField(str(i), t) for i, t in enumerate(types)])
    names = [*docs.columns, "lengths", "counts"]
    return docs.mapInArrow(partial(_built, at=at, ranks=ranks, pattern=pattern), inner) \
        .select(*(F.col(f"`{i}`").alias(n) for i, n in enumerate(names)))


def _edited(batches, ranks: str, pattern: str):
    words = Vocabulary.of(ranks, pattern)
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            texts, lengths, counts, sums, encoded = [], [], [], [], []
            for text, ls, cs, edits in zip(*(part.column(i) for i in range(part.num_columns - 4, part.num_columns)), strict=True):
                text, done = text.as_py() or "", 0
                tree = CountTree(ls.as_py() or [], cs.as_py() or [])
                for e in edits.as_py() or []:
                    if e is not None:
                        text, n = edit(text, tree, words, e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                        done += n
                ls, cs = tree.flat()
                texts.append(text)
                lengths.append(ls)
                counts.append(cs)
                sums.append(tree.total)
                encoded.append(done)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-4], pa.array(texts, pa.string()), _lists(lengths), _lists(counts),
                 pa.array(sums, pa.int64()), pa.array(encoded, pa.int64())],
                names=[str(i) for i in range(part.num_columns + 1)])


def apply_edits(trees: DataFrame, edits: str = "edits", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``trees`` (from ``build``) after the edits in the array column ``edits`` (start, removed, inserted), one by one.

    ``text``, ``lengths`` and ``counts`` follow; ``n_tokens`` is the new count and ``n_encoded`` the number of pre-tokens
    that were encoded for it. Places are code points of the text as the edits before have left it. Null edits and null
    lists of edits change nothing; null places are 0.
    """
    key = [c for c in trees.columns if c not in ("text", "lengths", "counts", edits, "n_tokens", "n_encoded")]
    rows = trees.select(*(F.col(f"`{c}`") for c in key), "text", "lengths", "counts", F.col(f"`{edits}`").cast(EDIT))
    types = [*(rows.schema[c].dataType for c in (*key, "text", "lengths", "counts")), T.LongType(), T.LongType()]
    inner = T.StructType([T.StructField(str(i), t) for i, t in enumerate(types)])
    names = [*key, "text", "lengths", "counts", "n_tokens", "n_encoded"]
    return rows.mapInArrow(partial(_edited, ranks=ranks, pattern=pattern), inner) \
        .select(*(F.col(f"`{i}`").alias(n) for i, n in enumerate(names)))


#: What the edits of the query put in: words, a contraction, white space that joins or parts pre-tokens, nothing.
INSERTED = ("", " and", "'s", "\n\n", " ", "é12", "--", "ing the")


def sample_edits(id_column: Column, every: int = 2000) -> Column:
    """An edit for each ``every`` characters of ``text``, at places that follow from the id."""
    n = F.coalesce(F.length("text"), F.lit(0))

    def one(i: Column) -> Column:
        h = F.xxhash64(id_column, i)
        return F.struct(F.pmod(h, n + 1).alias("start"), F.pmod(F.shiftright(h, 20), F.lit(12)).alias("removed"),
                        F.element_at(F.array(*map(F.lit, INSERTED)), (F.pmod(F.shiftright(h, 40), F.lit(len(INSERTED))) + 1)
                                     .cast("int")).alias("inserted"))

    return F.transform(F.sequence(F.lit(0), F.floor(n / every).cast("int")), one)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after a set of edits that follows from their ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = build(docs).withColumn("edits", sample_edits(F.col("doc_id"))).withColumn(
        "n_tokens_before", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).withColumn(
        "n_edits", F.size("edits").cast("long")).withColumn("n_pretokens", F.size("counts").cast("long"))
    found = apply_edits(trees)
    return found.select("doc_id", "n_pretokens", "n_tokens_before", "n_edits", "n_tokens", "n_encoded",
                        F.sha2("text", 256).alias("text_sha256"))
