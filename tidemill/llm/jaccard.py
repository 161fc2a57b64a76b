"""N-gram Jaccard join by parity sketches, and the components of its links.

Method. A document's set of shingles is hashed into m cells, and the hashes that fall into a cell are XORed: a parity
sketch. A shingle that only one of two documents has changes one cell at most, so the number of cells in which two
sketches differ is a lower bound of the symmetric difference of the sets. A link of sets of sizes a and b allows at
most D = (a + b)(100 - p) / (100 + p) such shingles (p: the threshold in percent), so of m = D + 1 + r cells at least
r + 1 agree (pigeonhole). Documents of a size band are joined on (band, cell, value); a document also probes the band
below if a partner can lie there. Candidates are verified on the whole sets.

Cells that hardly tell documents apart are left out without loss: the empty ones, and the values that many documents
share (a common passage). A document may leave out its r most frequent cells, counting the empty ones, as r + 1 agree
with any partner (a prefix filter over cells; r follows from the document's own size); a document that shares no more
cells than that has no link at all. Documents with more than r empty cells also join on the n - ceil(p n / 100) + 1
smallest of their shingle hashes.

Sets are compared as sets of 64-bit shingle hashes, and documents of the same set are one class (64-bit hash): within
a pair a false match has a chance of about a * b / 2**64. Cells travel as a bucket and 32 bits; two values that meet
by chance are one candidate more.

Scale. Only classes take part, so copies cost nothing. Signatures travel as packed arrays, one per task and bucket.
A signature that is frequent within one task is not gathered: its rows are spread and only its count goes to the
bucket. Links are sought star-wise: each group of equal signatures is compared with one centre at a time, and what has
become connected is not compared again. Then the pairs between the remaining components of a group are taken, of which bit
sketches (four parity bits a shingle) strike out nearly all that do not link before their sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import Steps, fresh, table
from tidemill.llm.graph import components
from tidemill.llm.words import NOT_SPACE, Words, mix, row_ranges, text_buffer
from tidemill.session import cut_lineage

SHINGLE = 5
PERCENT = 80
HOT = 64
FLUSH_ROWS = 400_000
GROWTH = 1.6
STAR_ROUNDS = 12
PRUNINGS = 2
#: Shingles whose signatures one task groups.
SHINGLES_PER_TASK = 1 << 23
HOME, PROBE, SMALLEST = 0, 1, 2
HAS_WORD = r"[^\x20\x09-\x0D]"


def bands(percent: int, largest: int) -> np.ndarray:
    """Rows (first size, last size, cells) up to ``largest``; smaller sets only link with equal ones.

    A set's partners lie in its own band or the next ones to it. The cells are so many that a tenth or so of them may be
    empty and the bound still tells documents apart.
    """
    out, low = [], max(1, -(-percent // max(1, 100 - percent)))
    while not out or out[-1][1] < largest:
        high = max(low, int(low * max(GROWTH, 100 / percent)))
        partner = 100 * high // percent
        differ = (high + partner) * (100 - percent) // (100 + percent)
        cells = -(-(differ + 4) * 100 // 82)
        out.append((low, high, cells))
        low = high + 1
    return np.array(out, dtype=np.int64)


class Sets:
    """Sorted distinct shingle hashes of some rows, with a class hash for each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, shingle: int):
        words = Words(data, offsets, NOT_SPACE)
        count = np.diff(words.bounds)
        at, found = words.windows(shingle)
        rows = words.rows[at]
        for size in range(1, shingle):
            if (count == size).any():
                i, h = words.windows(size)
                whole = count[words.rows[i]] == size
                rows, found = np.concatenate([rows, words.rows[i[whole]]]), np.concatenate([found, h[whole]])
        if len(rows) > len(at):
            order = np.argsort(rows, kind="stable")
            rows, found = rows[order], found[order]
        ends = np.searchsorted(rows, np.arange(len(count) + 1))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            found[a:b].sort()
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
        self.rows, self.hashes = rows[new], found[new]
        self.bounds = np.searchsorted(self.rows, np.arange(len(count) + 1))
        self.sizes = np.diff(self.bounds)
        self.marks = mix(self.hashes ^ np.uint64(0xA5A5A5A55A5A5A5A))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.marks)])
        self.classes = mix(total[self.bounds[1:]] - total[self.bounds[:-1]] + self.sizes.astype(np.uint64))

    def families(self, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(role, band of each row or -1, its cells, how many of them may differ or be left out for any partner)."""
        known = bands(percent, int(self.sizes.max(initial=1)))
        home = np.searchsorted(known[:, 0], self.sizes, "right") - 1
        below = np.maximum(home - 1, 0)
        probe = np.where((home > 0) & (percent * self.sizes <= 100 * known[below, 1]), below, -1)
        for role, band, partner in ((HOME, home, 100 * self.sizes // percent), (PROBE, probe, known[probe, 1])):
            cells = known[band, 2]
            yield role, band, cells, cells - (self.sizes + partner) * (100 - percent) // (100 + percent) - 1

    def cells(self, band: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and signature of every cell that is not empty, for the rows with a band."""
        pick = np.flatnonzero(band[self.rows] >= 0)
        if not len(pick):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        rows, hashes = self.rows[pick], self.hashes[pick]
        cell = ((hashes >> np.uint64(32)) * cells[rows].astype(np.uint64)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (cell[1:] != cell[:-1])]))
        value = np.bitwise_xor.reduceat(self.marks[pick], first)
        place = (band[rows[first]].astype(np.uint64) << np.uint64(40)) + cell[first]
        return rows[first], mix(value + mix(place))


    def sketch(self, row: int, band: int, percent: int) -> np.ndarray:
        """The parity bits of a set, as many as its band says: four for each shingle of the band's largest set."""
        if band < 0:
            return np.zeros(0, dtype=np.int64)
        words = -(-int(bands(percent, int(self.sizes.max(initial=1)))[band, 1]) * 4 // 64)
        hashes = self.hashes[self.bounds[row]:self.bounds[row + 1]]
        at = ((hashes >> np.uint64(32)) * np.uint64(64 * words)) >> np.uint64(32)
        return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * words) & 1).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], at: int, shingle: int) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(at))
        for a, b in row_ranges(offsets):
            yield batch.slice(a, b - a), Sets(data, offsets[a:b + 1], shingle)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _classify(shingle: int, percent: int):
    """(id, text key, text) to (id, text key, class, size, spare cells of both roles after the empty ones)."""

    def run(batches):
        for batch, sets in _sets(batches, 2, shingle):
            spare = []
            for _, band, cells, free in sets.families(percent):
                filled = np.bincount(sets.cells(band, cells)[0], minlength=len(sets.sizes))
                spare.append(np.where(band >= 0, free - cells + filled, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _signed(sets.classes), pa.array(sets.sizes, pa.int64()),
                 *(pa.array(x, pa.int64()) for x in spare)], names=["id", "key", "cls", "n", "spare0", "spare1"])

    return run


def _signatures(shingle: int, percent: int, buckets: int):
    """(text) to packed signatures: kind 0 for a bucket; kind 1 spread; kind 2 counts of what kind 1 has, for a bucket."""

    def packed(kind: int, bucket: np.ndarray, columns: list[np.ndarray], spread: int):
        order = np.argsort(bucket, kind="stable")
        names, first = np.unique(bucket[order], return_index=True)
        for name, rows in zip(names.tolist(), np.split(order, first[1:]), strict=True):
            yield name + spread, kind, name, b"".join(c[rows].tobytes() for c in columns)

    def emit(sig, cls, role, turn):
        bucket = ((sig >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        low = sig.astype(np.uint32)
        values, back, count = np.unique(sig, return_inverse=True, return_counts=True)
        hot = (count >= HOT)[back]
        columns = [low, cls, role]
        yield from packed(0, bucket[~hot], [c[~hot] for c in columns], 0)
        if hot.any():
            yield from packed(1, bucket[hot], [c[hot] for c in columns], 7919 * turn + 1)
            values, count = values[count >= HOT], count[count >= HOT]
            bucket = ((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            yield from packed(2, bucket, [values.astype(np.uint32), count.astype(np.uint32)], 0)

    def run(batches):
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        held: list[list[np.ndarray]] = []
        rows = 0

        def flush():
            sig, cls, role = (np.concatenate(x) for x in zip(*held, strict=True))
            part, kind, bucket, body = zip(*emit(sig, cls, role, turn), strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(bucket, pa.int64()),
                 pa.array(body, pa.binary())], names=["part", "kind", "bucket", "body"])

        for _, sets in _sets(batches, 0, shingle):
            one = np.zeros(len(sets.sizes), dtype=bool)
            one[np.unique(sets.classes, return_index=True)[1]] = True
            one &= sets.sizes > 0
            for role, band, cells, free in sets.families(percent):
                band = np.where(one, band, -1)
                at, sig = sets.cells(band, cells)
                held.append([sig, sets.classes[at], np.full(len(at), role, np.uint8)])
                rows += len(at)
                empty = cells - np.bincount(at, minlength=len(cells))
                for row in np.flatnonzero((band >= 0) & (empty > free)).tolist():
                    n, a = int(sets.sizes[row]), int(sets.bounds[row])
                    least = mix(sets.hashes[a:a + n - -(-percent * n // 100) + 1] + np.uint64(1))
                    held.append([least, np.full(len(least), sets.classes[row]), np.full(len(least), SMALLEST, np.uint8)])
                    rows += len(least)
            if rows > FLUSH_ROWS:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return run


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed signatures of whole buckets to (sig, cls, role, hot) of those that two classes share."""

    def unpack(bucket, body, *kinds):
        n, at, out = len(body) // sum(np.dtype(k).itemsize for k in kinds), 0, []
        for k in kinds:
            out.append(np.frombuffer(body, k, n, at))
            at += n * np.dtype(k).itemsize
        return [out[0].astype(np.uint64) | np.uint64(bucket << 32), *out[1:]]

    def rows(sig, cls, role, hot):
        for a in range(0, len(sig), 1 << 18):
            part = slice(a, a + (1 << 18))
            yield pa.RecordBatch.from_arrays(
                [_signed(sig[part]), _signed(cls[part]), pa.array(role[part].astype(np.int8)), pa.array(hot[part])],
                names=["sig", "cls", "role", "hot"])

    plain, counted = [], []  # of one partition of the buckets, as packed arrays
    for batch in batches:
        for kind, bucket, body in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if kind == 2:
                counted.append(unpack(bucket, body, np.uint32, np.uint32)[0])
                continue
            got = unpack(bucket, body, np.uint32, np.uint64, np.uint8)
            if kind == 1:
                yield from rows(*got, np.ones(len(got[0]), dtype=bool))
            else:
                plain.append(got)
    if not plain:
        return
    sig, cls, role = (np.concatenate(x) for x in zip(*plain, strict=True))
    del plain
    order = np.lexsort((cls, sig))
    sig, cls, role = sig[order], cls[order], role[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
    sig, cls, role = sig[new], cls[new], role[new]
    _, back, count = np.unique(sig, return_inverse=True, return_counts=True)
    spread = np.isin(sig, np.unique(np.concatenate(counted))) if counted else np.zeros(len(sig), dtype=bool)
    hot = (count[back] >= HOT) | spread
    keep = (count[back] > 1) | spread
    yield from rows(sig[keep], cls[keep], role[keep], hot[keep])


def _members(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, steps: Steps) -> DataFrame:
    """(sig, cls, role, n, shares): the shared signatures that a class may not leave out."""
    shingles = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shingles // SHINGLES_PER_TASK)
    packed = docs.select("text").mapInArrow(
        _signatures(shingle, percent, 4 * parts), "part long, kind int, bucket long, body binary")
    shared = written = steps.write(packed.repartition(parts, "part").mapInArrow(
        _group, "sig long, cls long, role byte, hot boolean"), "signatures")
    plain = F.col("role") != SMALLEST
    limits = classes.select("cls", "n", "spare0", "spare1")
    spare = F.when(F.col("role") == HOME, F.col("spare0")).otherwise(F.col("spare1"))
    rows = shared.filter("not hot").drop("hot").union(shared.filter("hot").drop("hot").distinct())
    for _ in range(PRUNINGS):
        # A link agrees on more than ``spare`` cells that are not empty, so a class that shares no more has none.
        live = rows.filter(plain).groupBy("cls", "role").agg(F.count("*").alias("shares")).join(limits, "cls") \
            .filter(F.col("shares") > spare).select("cls", "role")
        rows = rows.filter(plain).join(live, ["cls", "role"], "left_semi").select("sig", "cls", "role") \
            .union(rows.filter(~plain).select("sig", "cls", "role"))
        often = rows.groupBy("sig").agg(F.count("*").alias("often")).filter("often > 1")
        rows = steps.write(rows.join(often, "sig").select("sig", "cls", "role", "often"), "pruned")
        steps.drop(written)
        written = rows
    # A class may leave out its r most frequent cells; the empty ones are already taken off ``spare``.
    ranked = rows.filter(plain).groupBy("cls", "role").agg(
        F.array_sort(F.collect_list(F.struct("often", "sig"))).alias("cells")).join(limits, "cls")
    left = F.greatest(F.size("cells") - F.greatest(spare, F.lit(0)).cast("int"), F.lit(0))
    must = ranked.select(F.explode(F.slice("cells.sig", F.lit(1), left)).alias("sig"), "cls", "role", "n",
                         F.size("cells").alias("shares"))
    least = rows.filter(~plain).join(classes.select("cls", "n"), "cls").select(
        "sig", "cls", "role", "n", F.lit(0).alias("shares"))
    kept = must.union(least)
    often = kept.groupBy("sig").agg(F.count("*").alias("k")).filter("k > 1").select("sig")
    members = steps.write(kept.join(often, "sig"), "members")
    steps.drop(written)
    return members


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select(
        "a", "b", (F.size("x") + F.size("y")).cast("long").alias("total"),
        F.size(F.array_intersect("x", "y")).cast("long").alias("common"))
    return both.filter(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def _near(percent: int, a: str, b: str):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _meets(a, b):
    """Whether a pair with these roles is looked for in this band: one of the two is at home there."""
    return (a != PROBE) | (b != PROBE)


def class_components(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(cls, comp) for the classes that link with another one."""
    steps = Steps(docs.sparkSession)
    members = _members(docs, classes, shingle, percent, steps)
    wanted = members.select("cls").distinct().join(classes, "cls").select("cls", "key", "id")

    def sets(batches):
        for batch, found in _sets(batches, 1, shingle):
            same = np.flatnonzero(found.classes.view(np.int64) == batch.column(0).to_numpy()).tolist()
            if same:
                bits = [[found.sketch(row, int(band[row]), percent) for row in same]
                        for _, band, _, _ in found.families(percent)]
                whole = [found.hashes[found.bounds[row]:found.bounds[row + 1]].view(np.int64) for row in same]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(same)), *(pa.array(x, pa.list_(pa.int64())) for x in (whole, *bits))],
                    names=["cls", "shingles", "bits0", "bits1"])

    texts = docs.join(wanted, (docs["key"] == wanted["key"]) & docs["id"].eqNullSafe(wanted["id"]))
    found = texts.select(wanted["cls"], docs["text"]).mapInArrow(
        sets, "cls long, shingles array<long>, bits0 array<long>, bits1 array<long>")
    found = steps.write(found.dropDuplicates(["cls"]), "sets")

    comps = members.select("cls").distinct().select("cls", F.col("cls").alias("comp"))
    comps = steps.write(comps, "comps")
    tried = None

    def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
        """``comps`` after the links between them."""
        a = comps.select(F.col("cls").alias("a"), F.col("comp").alias("ca"))
        b = comps.select(F.col("cls").alias("b"), F.col("comp").alias("cb"))
        roots = components(links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        after = steps.write(comps.join(roots, comps["comp"] == roots["node"], "left").select(
            "cls", F.coalesce("root", "comp").alias("comp")), "comps")
        steps.drop(comps)
        return after

    def open_groups(comps: DataFrame) -> DataFrame:
        """Members of the groups that lie in more than one component."""
        now = members.join(comps, "cls")
        split = now.groupBy("sig").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).filter("l < h")
        return now.join(split.select("sig"), "sig")

    for turn in range(STAR_ROUNDS):
        left = steps.write(open_groups(comps), "open")
        # First the member that shares most, which tends to be the text that others are copies of, then any.
        order = F.lit(0) if turn else -F.col("shares")
        centre = left.groupBy("sig").agg(F.min(F.struct(
            order.alias("o"), F.xxhash64("cls", F.lit(turn)).alias("h"), "cls", "role", "n", "comp")).alias("c"))
        star = left.join(centre, "sig").filter((F.col("comp") != F.col("c.comp")) & _near(percent, "n", "c.n")
                                               & _meets(F.col("role"), F.col("c.role")))
        pairs = star.select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = steps.write(pairs, "pairs")
        steps.drop(left)
        links = steps.write(_verified(pairs, found, percent), "links")
        tried = pairs if tried is None else tried.union(pairs)
        n_links = links.count()
        if n_links:
            comps = joined(comps, links)
        steps.drop(links)
        if 100 * n_links < pairs.count():
            break

    # What is left of the groups, pair by pair; the bits that differ are a lower bound of the symmetric difference.
    bits = F.when(F.col("role") == HOME, F.col("bits0")).when(F.col("role") == PROBE, F.col("bits1"))
    left = steps.write(open_groups(comps), "open").join(found.drop("shingles"), "cls").withColumn("bits", bits)
    x, y = (left.select("sig", *(F.col(c).alias(f"{side}_{c}") for c in ("cls", "role", "n", "comp", "bits"))) for side in "ab")
    allowed = F.floor((F.col("a_n") + F.col("b_n")) * (100 - percent) / (100 + percent))
    differ = F.aggregate(F.zip_with("a_bits", "b_bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)
    rest = x.join(y, "sig").filter(
        (F.col("a_cls") < F.col("b_cls")) & (F.col("a_comp") != F.col("b_comp")) & _near(percent, "a_n", "b_n")
        & _meets(F.col("a_role"), F.col("b_role")) & ((differ <= allowed) | (F.col("a_role") == SMALLEST)))
    rest = rest.select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).distinct()
    rest = steps.write(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    links = steps.write(_verified(rest, found, percent), "links")
    if not links.isEmpty():
        comps = joined(comps, links)
    steps.drop_all_but(comps)
    return comps


def cluster(docs: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (its id and ``text``): ``id``, ``key`` (hash of the text), ``cls``, ``n``,
    ``comp`` (class hash that names the component) and ``component_id``.

    Documents link when the Jaccard index of their sets of distinct ``shingle``-word shingles is ``percent`` or more;
    ``component_id`` is the smallest id reachable by links. With fewer words the whole sequence is the only shingle;
    null, empty and blank texts have no shingle and link with nothing, not even each other. Repeated rows are kept and
    share a component; null ids are no candidates for the smallest, and a component of null ids has a null id.
    Only the two columns are read, so others may have any name.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(F.col("text")).alias("key"),
                       F.col("text").cast("string").alias("text"))
    placed = cut_lineage(rows.select("id", "key", "text").mapInArrow(
        _classify(shingle, percent),
        f"id {rows.schema['id'].dataType.simpleString()}, key long, cls long, n long, spare0 long, "
        "spare1 long"), "docs")
    of_class = ("n", "spare0", "spare1")
    classes = cut_lineage(placed.filter("n > 0").groupBy("cls").agg(
        F.min("id").alias("least"), F.min(F.struct("id", "key")).alias("rep"), *(F.first(c).alias(c) for c in of_class))
        .select("cls", "least", "rep.id", "rep.key", *of_class), "classes")
    comps = class_components(rows, classes.drop("least"), shingle, percent)
    roots = classes.select("cls", "least").join(comps, "cls", "left") \
        .select("cls", "least", F.coalesce("comp", "cls").alias("comp"))
    least = roots.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_class = roots.join(least, "comp").select("cls", "comp", "component_id")
    out = placed.withColumn("cls", F.when(F.col("n") > 0, F.col("cls"))).join(by_class, "cls", "left")
    return out.select("id", "key", "cls", "n", "comp",
                      F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (of repeated rows, one; null ids come last).

    Rows without a shingle link with nothing and are all kept.
    """
    best = cluster(docs, id_column, shingle, percent).filter("n > 0").groupBy("comp").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("best"))
    key, turn = fresh("text_key", docs.columns), fresh("turn", docs.columns)
    chosen = best.select(F.col("best.id").alias("best_id"), F.col("best.key").alias("best_key"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    some = F.coalesce(F.col("text").rlike(HAS_WORD), F.lit(False))
    picked = docs.filter(some).withColumn(key, F.xxhash64("text"))
    picked = picked.join(chosen, (F.col(key) == F.col("best_key")) & F.col(f"`{id_column}`").eqNullSafe(
        F.col("best_id")), "left_semi")
    once = Window.partitionBy(key, F.col(f"`{id_column}`")).orderBy("text")
    picked = picked.withColumn(turn, F.row_number().over(once)).filter(F.col(turn) == 1)
    return picked.select(*own).unionByName(docs.filter(~some))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ``n_shingles`` and ``component_id``, the smallest doc_id that links of Jaccard 0.8 reach."""
    found = cluster(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
