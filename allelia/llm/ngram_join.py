"""Exact n-gram Jaccard join with a prefix tree, for connected components of near copies.

1. Every document becomes a set of 64-bit shingle hashes. Documents of equal sets are one class, so copies cost nothing.
2. One global order of all shingles: by how frequent they are, then by hash. The frequent ones are counted over all
   documents (by 32-bit buckets of their hashes); the ORDERED most frequent buckets are told apart by the logarithm of
   their count, all rarer ones are equal but for their hash. Whatever the counts, it is one order for all sets.
3. Two sets that link share, among the n - ceil(n percent / 100) + SHARED last of each one's order, its rarest, SHARED
   elements (the prefix filter, which loses nothing; tiny sets share all that a link needs). Each set gives these elements
   as keys; along a key sets go by size, and where the next is too long for the one before, none after links with any
   before, so the run is cut there. In a run of up to FEW sets all pairs are counted, and a pair is a link between
   candidates if it shares SHARED keys; the sets of a longer run are all tied. So unlike texts that share a rare shingle or two
   by chance, as more do the larger a corpus is, aren't tied, and sets are candidates that are in one component.
4. Components beyond BLOCK elements are split by a second kind of keys: two sets that link differ in at most D elements (by
   their sizes), so of D + 1 ranges of hashes one holds the same elements of both, and what a set has in each range, as
   one hash, loses nothing either. Where a range would hold fewer than HELD elements on average, which follows from the
   similarity alone, these keys cost much and tell little, and aren't used.
5. A component is cut by length (a link needs lengths within the similarity) and, beyond BLOCK elements, dealt by a hash
   into blocks: every two classes that can link meet in a group, and no group grows with the data. Blocks meet a bounded
   number of the component's sets first, for most of a large cluster is one component then; blocks meet each other only
   for the sets that are still apart.
6. Within a group, sets are stored in a trie in the global order, frequent elements first, so that shared parts are
   shared paths. A set walks the trie with its partial overlap; a subtree is left when its remaining length can't reach
   the needed overlap, or when all of it is in the set's component already.
7. Links become components; each row gets its component's smallest id.

Words are runs of bytes other than white space (space and 09-0D), A-Z lower-cased. A set has the distinct n-word shingles; a text of fewer
words gives its whole sequence as one; one without words is empty and links with nothing. Hashes are 64 bits: two sets
are taken as equal, or two shingles, with a chance of about 2^-64 a pair.

Defined results: a null text is empty; a document of null id has a null component and lends no name, but its text still
links others; rows that share an id keep their own sets; an empty table gives no rows; further columns aren't read. A
text's set takes 8 bytes a word in memory; the text itself is hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, fits, materialize, mix, share, shingles, sieve, sifted, sliced, small, tidy, word_hashes

#: Elements of all sets in one block, and of a component that is small.
BLOCK, SMALL = 800_000, 50_000
#: Sizes from which on a band of the second rule begins: powers of 1.5.
EDGES = np.unique([int(np.ceil(1.5**b)) for b in range(60)])
#: Sizes of sets from which on ranges are cut in parts, and how many.
PAIRED, QUARTERS = 1000, 4
#: Elements that ranges must hold on average for the second kind of keys: from a similarity of 0.89 on.
HELD = 8
#: Rarest elements that two sets share if they link, or as many as a link needs; members of a run whose pairs are counted.
SHARED, FEW = 3, 16
#: Runs that the key of an empty range is dealt to.
EMPTY_RUNS = 64
#: Elements of small components that are looked at in one group.
TOGETHER = 40_000
#: Sizes from which on a band of the second rule begins: powers of 1.5.
EDGES = np.unique([int(np.ceil(1.5**b)) for b in range(60)])
#: Buckets that the order tells apart by their frequency; 5 bytes each wherever sets are ordered.
ORDERED = 1 << 20
#: Documents that a shingle must be in (by its bucket) to be told apart, and from how many on its key's run is split.
LEAST_COMMON, HOT = 4, 1 << 13
#: Buckets that a task sorts at once, and the bits of a bucket within its range.
FLUSH, LOW = 1 << 21, 20
#: Classes that a task remembers, so that copies of one text give their keys once.
REMEMBERED = 200_000


def sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, doc = word_hashes(texts)
    grams, of = shingles(hashes, doc, n)
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    return [np.unique(grams[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def class_of(found: np.ndarray) -> int:
    """A set's 64-bit name."""
    if not len(found):
        return 0
    total = mix(
        mix(found + np.uint64(0x51)).sum(keepdims=True) + np.bitwise_xor.reduce(
            mix(found), keepdims=True
        ) * np.uint64(3) + np.uint64(len(found))
    )
    return int(total.view(np.int64)[0])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]


class Order:
    """The global order of shingles: frequent ones first, by the logarithm of their bucket's count, then by hash."""

    def __init__(self, buckets: np.ndarray, levels: np.ndarray):
        place = np.argsort(buckets)
        self.buckets, self.levels = buckets[place], levels[place]

    def level(self, found: np.ndarray) -> np.ndarray:
        """0 for the shingles that aren't told apart by frequency."""
        if not len(self.buckets):
            return np.zeros(len(found), np.int8)
        bucket = (found >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        return np.where(self.buckets[at] == bucket, self.levels[at], np.int8(0))

    def places(self, found: np.ndarray) -> np.ndarray:
        """How ascending distinct hashes go in this order."""
        return np.argsort(-self.level(found), kind="stable")

    def keys(self, found: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """A set's keys, the rarest elements of which any set that links with it, but isn't equal, has needed(n) or more of the
        smaller one; and their levels."""
        n = len(found)
        if 100 * n < percent * (n + 1):  # no other set is close enough
            return found[:0], np.zeros(0, np.int8)
        rare = self.places(found)[-(n - -(-percent * n // 100) + int(needed(n, percent))) :]
        return found[rare], self.level(found[rare])


def needed(n: np.ndarray | int, percent: int) -> np.ndarray:
    """How many keys a set of n elements shares with any of n or more that it links with."""
    return np.minimum(SHARED, -(-percent * n // 100))


def _told_apart(buckets: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Range and gaps of ascending 32-bit buckets: of each range, the differences as 16-bit numbers, 65535 for that and no bucket."""
    place = (buckets >> np.uint32(LOW)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(buckets)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        low = (buckets[a:b] & np.uint32((1 << LOW) - 1)).astype(np.int64)
        gap = np.diff(low, prepend=0)
        out = np.full(len(gap) + int((gap // 65535).sum()), 65535, np.uint16)
        out[np.cumsum(gap // 65535 + 1) - 1] = gap % 65535
        yield int(place[a]), out.tobytes()


def _buckets(gaps: bytes) -> np.ndarray:
    """The buckets, within their range, that these gaps stand for."""
    found = np.frombuffer(gaps, np.uint16)
    return np.cumsum(found, dtype=np.int64)[found != 65535]


class Counts:
    """How often each bucket of a range was seen; never more than a range's buckets and FLUSH of what is not added up yet."""

    def __init__(self) -> None:
        self.found, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, buckets: np.ndarray) -> None:
        self.held.append(buckets)
        self.size += len(buckets)
        if self.size >= FLUSH:
            self.sum()

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending buckets and their counts."""
        weights = np.concatenate([self.counts, np.ones(self.size, np.int64)])
        self.found, which = np.unique(np.concatenate([self.found, *self.held]), return_inverse=True)
        self.counts = np.bincount(which, weights=weights, minlength=len(self.found)).astype(np.int64)
        self.held, self.size = [], 0
        return self.found, self.counts


def frequencies(docs: DataFrame, n: int) -> Order:
    """The order, from counts of all documents' shingles. The driver sees at most ORDERED buckets.

    A task sorts FLUSH shingles' buckets at a time and sends the gaps between them, two bytes each, by ranges; a range's
    counts are then added up, streamed.
    """

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            rows = list(_told_apart(np.sort(np.concatenate(held))))
            return pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["range", "gaps"]
            )

        for batch in batches:
            for small_ in sliced([batch], 1):
                for x in sets(_texts(small_), n):
                    held.append((x >> np.uint64(32)).astype(np.uint32))
                    size += len(x)
                if size >= FLUSH:
                    yield told()
                    held, size = [], 0
        if size:
            yield told()

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, Counts()

        def told() -> pa.RecordBatch:
            found, counts = seen.sum()
            low = found[counts >= LEAST_COMMON]
            level = np.log2(counts[counts >= LEAST_COMMON]).astype(np.int8)
            return pa.RecordBatch.from_arrays(
                [pa.array((low + (at << LOW)).astype(np.uint32).view(np.int32)), pa.array(level)], names=["bucket", "level"]
            )

        for batch in batches:
            for place, gaps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if place != at:
                    if at is not None:
                        yield told()
                    at, seen = place, Counts()
                seen.add(_buckets(gaps))
        if at is not None:
            yield told()

    sent = docs.mapInArrow(send, "range int, gaps binary").repartition("range").sortWithinPartitions("range")
    counts = materialize(sent.mapInArrow(add, "bucket int, level tinyint"), "frequencies")
    total, least = 0, 127
    for r in counts.groupBy("level").agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect():  # a row per power of two
        total += r["k"]
        if total > ORDERED:
            break
        least = r["level"]
    told = counts.where(F.col("level") >= least).toArrow()
    return Order(told.column("bucket").to_numpy().view(np.uint32), told.column("level").to_numpy().astype(np.int8))


def named(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n (set size), class of each document, and what columns there are after doc_id and text."""
    more = docs.schema.fields[2:]

    @tidy
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found = sets(_texts(batch), n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(x) for x in found], pa.int64()),
                    pa.array([class_of(x) for x in found], pa.int64()), *batch.columns[2:]
                ],
                names=["doc_id", "n", "class", *(f.name for f in more)]
            )

    return docs.mapInArrow(
        make, ", ".join(["doc_id long, n long, class long", *(f"{f.name} {f.dataType.simpleString()}" for f in more)])
    )


def range_keys(found: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """What a set holds in ranges of hashes, as one hash each, and which are empty: sets that link have one in common.

    D is the most elements that the largest sets of the set's band of sizes may differ in; a set near its band's end has
    the next band's keys too. In bands of up to PAIRED there are D + 1 ranges, of which one is equal in both. Beyond, there are half
    as many, of which one differs in an element at most; that one is cut in QUARTERS parts, all but one of which are equal, so
    its keys are what it holds without each part: twice as many keys, of half as many elements again.
    """
    n, out, empty = len(found), [], []
    if 100 * n < percent * (n + 1):  # no other set is close enough
        return found[:0], np.zeros(0, bool)
    own = int(np.searchsorted(EDGES, n, side="right")) - 1
    inner = mix(found ^ np.uint64(0x5DEECE66D))
    for band in (own, own + 1) if 100 * n >= percent * EDGES[own + 1] else (own,):
        most = int((100 - percent) * 2 * (EDGES[band + 1] - 1) // (100 + percent))
        paired = EDGES[band + 1] > PAIRED
        ranges = (most // 2 + 1) * QUARTERS if paired else most + 1
        sums = np.zeros(ranges, np.uint64)
        np.add.at(sums, (((found >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64), inner)
        if paired:
            parts = sums.reshape(-1, QUARTERS)
            held = parts != 0
            sums = (parts.sum(1, keepdims=True) - parts).ravel()
            empty.append((held.sum(1, keepdims=True) - held == 0).ravel())
        else:
            empty.append(sums == 0)
        out.append(mix(sums + mix(np.arange(ranges, dtype=np.uint64) * np.uint64(1024) + np.uint64(band))))
    return np.concatenate(out), np.concatenate(empty)


class Once:
    """Tells whether a class is new to this task, of the REMEMBERED last ones at least."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, name: int) -> bool:
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        known = name in self.seen
        self.seen.add(name)
        return not known


_RUNS = ["key", "kind", "a", "b", "lo", "hi"]


def _runs(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, salt, kind, lo, hi = lo, class) in this order: links (key null, kind, a, b) within each run, and the runs of salted keys.

    In unsalted runs of kind 0 of up to FEW classes, every pair that sizes allow is a row, with 1 for lo and needed for hi.
    In all others members are linked with the first, and lo and hi are 0.
    """
    open_ = None  # key, salt, kind, sizes from and to, and first class of the run, not of pairs, that may go on
    held = None  # rows of the run of pairs that may go on

    def told(key: np.ndarray, kind: np.ndarray, first: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(kind), pa.nulls(len(key), pa.int64()), pa.array(first), pa.array(lo), pa.array(hi)],
            names=_RUNS
        )

    def linked(kind: np.ndarray, a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), *map(pa.array, (kind, a, b, lo, hi))], names=_RUNS)

    for batch in chain(batches, [None]):
        rows = [batch.column(i).to_numpy() for i in (0, 1, 2, 3, 5)] if batch is not None else [np.zeros(0, np.int64)] * 5
        if held is not None:
            rows, held = [np.concatenate(x) for x in zip(held, rows, strict=True)], None
        if not len(rows[0]):
            continue
        again = np.zeros(len(rows[0]), bool)  # a class that more than one task gave
        again[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in rows])
        key, salt, kind, lo, name = (x[~again] for x in rows)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1]) | (percent * lo[1:] > 100 * lo[:-1])
        if open_ is not None:
            new[0] = (key[0], salt[0], kind[0]) != open_[:3] or percent * lo[0] > 100 * open_[4]
            if new[0]:
                if open_[1] >= 0:
                    yield told(*(np.array([x], np.int64) for x in (open_[0], open_[2], open_[5], open_[3], open_[4])))
                open_ = None
        starts = np.flatnonzero(new)
        starts = starts if new[0] else np.concatenate([[0], starts])
        sizes = np.diff(starts, append=len(key))
        pairs = (salt[starts] < 0) & (kind[starts] == 0) & (sizes <= FEW)
        pairs[0] &= bool(new[0])
        if pairs[-1] and batch is not None:
            held = [x[starts[-1] :] for x in (key, salt, kind, lo, name)]
            key, salt, kind, lo, name = (x[: starts[-1]] for x in (key, salt, kind, lo, name))
            starts, sizes, pairs = starts[:-1], sizes[:-1], pairs[:-1]
            if not len(starts):
                continue
        run, alike = np.repeat(np.arange(len(starts)), sizes), np.repeat(pairs, sizes)
        near = [
            np.flatnonzero(alike[d:] & (run[d:] == run[:-d]) & (percent * lo[d:] <= 100 * lo[:-d]))
            for d in range(1, int(sizes[pairs].max(initial=0)))
        ]
        x = np.concatenate([np.zeros(0, np.int64), *near])
        y = np.concatenate([np.zeros(0, np.int64), *(at + d for d, at in enumerate(near, 1))])
        if len(x):
            yield linked(kind[x], name[x], name[y], np.ones(len(x), np.int64), needed(lo[x], percent))
        first, low, ends = name[starts], lo[starts], starts + sizes - 1
        if not new[0]:
            first[0], low[0] = open_[5], open_[3]
        of = np.repeat(first, sizes)
        links_ = np.unique(np.stack([kind, name, of], 1)[(of != name) & ~alike], axis=0)
        if len(links_):
            zero = np.zeros(len(links_), np.int64)
            yield linked(*(links_[:, i] for i in range(3)), zero, zero)
        ended = starts if held is not None else starts[:-1]  # where rows are held, the run before them has ended
        over = np.flatnonzero(salt[ended] >= 0)
        if len(over):
            yield told(key[starts[over]], kind[starts[over]], first[over], low[over], lo[ends[over]])
        open_ = None if held is not None or pairs[-1] else (key[-1], salt[-1], kind[-1], low[-1], lo[-1], first[-1])
    if open_ is not None and open_[1] >= 0:
        yield told(*(np.array([x], np.int64) for x in (open_[0], open_[2], open_[5], open_[3], open_[4])))


def _merged(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, salt, kind, lo, hi, class) of runs, in this order: links (key null, kind, a, b) between the first classes of those that meet."""
    last, reach, center = None, 0, 0
    for batch in batches:
        out: list[tuple] = []
        for k, _, kind, x, y, c in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if (k, kind) == last and percent * x <= 100 * reach:
                reach = max(reach, y)
                if c != center:
                    out.append((None, kind, c, center, 0, 0))
            else:
                last, reach, center = (k, kind), y, c
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=_RUNS)


def both_kinds(percent: int) -> bool:
    """Whether ranges hold enough at this similarity."""
    return 100 + percent >= 2 * (100 - percent) * HELD


def candidates(docs: DataFrame, n: int, percent: int, order=None) -> DataFrame:
    """a, b: links between classes; every two classes that can link are in one component. By their rarest elements in this
    order, or without one by what they hold in ranges.

    A key's classes are sorted by size and streamed, never gathered. In a run of FEW or less each pair is counted, and those that
    share fewer keys than a link has go; they don't link, or are tied by a longer run. The run of a key that HOT or more documents
    have, or of an empty range, is dealt by class to salted runs, whose firsts and sizes make a second, short run.
    """

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = Once()
        for batch in sliced(batches, 1):
            parts = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))]
            for x in sets(_texts(batch), n):
                if len(x) and new(name := class_of(x)):
                    if order is None:
                        keys, empty = range_keys(x, percent)
                        deal = np.where(empty, EMPTY_RUNS, 0)
                    else:
                        keys, level = order.value.keys(x, percent)
                        deal = np.where(level >= hot, np.int64(1) << np.maximum(level.astype(np.int64) - hot + 1, 0), 0)
                    parts.append(
                        (
                            keys, np.where(deal > 0, name % np.maximum(deal, 1), -1), np.full(len(keys), len(x)),
                            np.full(len(keys), name)
                        )
                    )
            key, salt, size, name = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), *map(pa.array, (salt, np.full(len(key), kind), size, size, name))],
                names=["key", "salt", "kind", "lo", "hi", "class"]
            )

    hot, kind = HOT.bit_length() - 1, int(order is None)
    spark, out = docs.sparkSession, "key long, kind long, a long, b long, lo long, hi long"
    order_ = ["key", "salt", "kind", "lo", "class"]
    shared = docs.mapInArrow(
        emit, "key long, salt long, kind long, lo long, hi long, class long"
    ).repartition("key", "salt").sortWithinPartitions(order_)
    bounded_batches(spark, 20_000)
    pair = F.expr("key IS NULL AND hi > 0")
    runs = shared.mapInArrow(tidy(lambda batches: _runs(percent, batches)), out).select(
        "key", "kind", "a", "b", F.when(pair, 0).otherwise(F.col("lo")).alias("lo"), "hi", F.when(pair, F.col("lo")).alias("times")
    )
    runs = runs.groupBy("key", "kind", "a", "b", "lo", "hi").agg(F.sum("times").alias("times"))
    found = materialize(runs.where("times IS NULL OR times >= hi").drop("times"), "runs")
    bounded_batches(spark)
    firsts = found.where("key IS NOT NULL").select(
        "key", F.lit(-1).cast("long").alias("salt"), "kind", "lo", "hi", F.col("b").alias("class")
    )
    met = firsts.repartition("key").sortWithinPartitions(order_).mapInArrow(lambda batches: _merged(percent, batches), out)
    return found.where("key IS NULL").select("a", "b").unionByName(met.select("a", "b"))


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers of all ranges (start, size), one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Trie:
    """Distinct ascending integer arrays as a compressed trie.

    Nodes are numbered by levels, so a node's children, and their edges, lie together and are matched at once. A node
    knows the shortest and longest set below it, and its sets' range in depth-first order.
    """

    def __init__(self, found: list[np.ndarray]) -> None:
        order = sorted(range(len(found)), key=lambda i: found[i].tolist())
        # sets in lexicographic order share with the next one `common` elements; nodes are the ranges that share more
        common = [0] * (len(order) + 1)
        for k, (i, j) in enumerate(zip(order, order[1:], strict=False), 1):
            both = min(len(found[i]), len(found[j]))
            differ = np.flatnonzero(found[i][:both] != found[j][:both])
            common[k] = int(differ[0]) if len(differ) else both
        self.order = np.array(order)
        level, at = [(0, len(order), 0)], 0
        nodes, kids, edges, member = [(0, len(order), 0)], [], [], []
        while level:
            below: list[tuple[int, int, int]] = []
            for low, high, depth in level:
                mine = low if len(found[order[low]]) == depth else -1  # the set that ends here comes first
                member.append(order[mine] if mine >= 0 else -1)
                first, start = len(nodes) + len(below), low + (mine >= 0)
                while start < high:
                    stop = start + 1
                    while stop < high and common[stop] > depth:
                        stop += 1
                    reach = min(common[start + 1 : stop], default=len(found[order[start]]))
                    below.append((start, stop, reach))
                    edges.append(found[order[start]][depth:reach])
                    start = stop
                kids.append((first, len(nodes) + len(below) - first))
            nodes += below
            level, at = below, at + 1
        self.low, self.high, self.depth = (np.array(x) for x in zip(*nodes, strict=True))
        self.first, self.kids = (np.array(x) for x in zip(*kids, strict=True))
        self.member = np.array(member)
        self.edge = np.concatenate([*edges, np.zeros(0, np.int64)])
        self.length = np.array([0, *map(len, edges)])
        self.start = np.cumsum(self.length) - self.length
        self.last = np.array([-1, *(x[-1] for x in edges)])
        sizes = np.array([len(found[i]) for i in order])
        self.shortest, self.longest = self._over(sizes, np.minimum), self._over(sizes, np.maximum)

    def _over(self, values: np.ndarray, f: np.ufunc) -> np.ndarray:
        """f over each node's sets, from values in depth-first order."""
        return f.reduceat(np.append(values, values[-1]), np.stack([self.low, self.high], 1).ravel())[::2]

    def uniform(self, labels: np.ndarray) -> np.ndarray:
        """Each node's label if all sets below have it, else -1."""
        mine = labels[self.order]
        low, high = self._over(mine, np.minimum), self._over(mine, np.maximum)
        return np.where(low == high, low, -1)


class Union:
    """Union-find over places."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def links(
    found: list[np.ndarray], percent: int, order: Order | None = None, asks: np.ndarray | None = None,
    roots: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct sets: places of two that reach the similarity.

    asks: where given, only pairs with an asking set are looked at. roots: where given, sets of equal roots are known to
    be in one component.
    """
    values = np.unique(np.concatenate(found))
    rank = np.empty(len(values), np.int64)
    rank[(order or Order(np.zeros(0, np.uint32), np.zeros(0, np.int8))).places(values)] = np.arange(len(values))
    local = [np.sort(rank[np.searchsorted(values, x)]) for x in found]
    trie, union, out = Trie(local), Union(len(found)), []
    if roots is not None:
        _, first, which = np.unique(roots, return_index=True, return_inverse=True)
        for i, k in enumerate(first[which].tolist()):
            union.join(i, k)
    mark = np.zeros(len(values) + 1, np.int64)
    asking = range(len(found)) if asks is None else np.flatnonzero(asks).tolist()
    for turn, item in enumerate(sorted(asking, key=lambda i: (len(local[i]), i))):
        if turn % 32 == 0:  # components only grow, so an older view leaves out less, never more
            uniform = trie.uniform(np.array([union.find(i) for i in range(len(found))]))
        mine = local[item]
        size, least = len(mine), -(-percent * len(mine) // 100)  # no shorter set links
        mark[mine] = 1
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            of, n = trie.member[nodes], trie.depth[nodes]
            for other in of[(of >= 0) & (of != item) & (100 * overlap >= percent * (size + n - overlap))].tolist():
                if union.join(item, other):
                    out.append((other, item))
            kids = spans(trie.first[nodes], trie.kids[nodes])
            if not len(kids):
                break
            overlap = np.repeat(overlap, trie.kids[nodes])
            length = trie.length[kids]
            got = overlap + np.add.reduceat(mark[trie.edge[spans(trie.start[kids], length)]], np.cumsum(length) - length)
            left = size - np.searchsorted(mine, trie.last[kids], side="right")  # of mine, beyond the edge
            most = got + np.minimum(left, trie.longest[kids] - trie.depth[kids])
            low = np.maximum(trie.shortest[kids], least)
            open_ = (trie.longest[kids] >= least) & (
                (100 + percent) * most >= percent * (size + low)
            ) & (uniform[kids] != union.find(item))
            nodes, overlap = kids[open_], got[open_]
        mark[mine] = 0
    return out


def join(documents: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: components of the links at percent / 100 Jaccard similarity or more."""
    return _joined(documents, n, percent, None)


def copies(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_hash of the documents that go if one row of each component stays: that of the least id and, in it, text hash.

    Documents of null id, and those without a word, don't go.
    """
    found = _joined(documents, n, percent, F.xxhash64(F.col("text").cast("string")))
    return found.where(
        "doc_id IS NOT NULL AND n_shingles > 0 AND (doc_id <> component_id OR text_hash <> first_hash)"
    ).select("doc_id", "text_hash")


def _chosen(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents (doc_id, text) whose id, null included, is in wanted's column first; where that is too large to broadcast, some
    others too. No text is shuffled."""
    ids = wanted.select(F.col("first").alias("doc_id")).distinct()
    if fits(ids):
        return docs.join(F.broadcast(ids), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    held, empty = sieve(ids), not ids.where("doc_id IS NULL").isEmpty()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            found = sifted(held.value, batch.column(0).fill_null(0).to_numpy())
            yield batch.filter(pa.array(np.where(null, empty, found)))

    return docs.mapInArrow(choose, docs.schema)


def _meet(docs: DataFrame, asked: DataFrame, n: int, percent: int, order) -> DataFrame:
    """(a, b): the links found in each group (part, band, x, y, z) of asked, which has class, first, asks and root besides."""

    @tidy
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = Once()
        for batch in sliced(batches, 1):
            found = [(name, x.tobytes()) for x in sets(_texts(batch), n) if new(name := class_of(x))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())],
                names=["class", "grams"]
            )

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["asks", "class"], ascending=[False, True]).drop_duplicates("class", ignore_index=True)
        out = links(
            [np.frombuffer(x, np.uint64) for x in frame["grams"]], percent, order.value, frame["asks"].to_numpy(bool),
            frame["root"].to_numpy()
        )
        names = frame["class"].to_numpy()
        return pd.DataFrame({"a": names[[x for x, _ in out]], "b": names[[y for _, y in out]]}, dtype="int64")

    # a class whose documents all lack an id is found by its null id
    chosen = _chosen(docs, asked)
    full = chosen.mapInArrow(again, "class long, grams binary").join(asked.drop("first"), "class")
    return full.groupBy("part", "band", "x", "y", "z").applyInPandas(meet, "a long, b long")


def _large(docs: DataFrame, members: DataFrame, plan: DataFrame, n: int, percent: int, order) -> DataFrame:
    """The links of the parts beyond BLOCK elements; plan: part, band, size, all.

    Each block meets a bounded number of the part's classes, its seeds. What is then outside the part's largest component
    meets all blocks of its own and the neighbouring bands, in chunks; within that component no link is needed.
    """
    blocks = plan.select("part", "band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), "all")
    mine = F.pmod(F.xxhash64("class", F.lit(7)), F.col("blocks")).cast("int")
    placed = materialize(members.join(small(blocks), ["part", "band"]).withColumn("x", mine), "placed")
    spot = F.pmod(F.xxhash64("class", F.lit(8)), F.lit(1 << 20))
    seeds = placed.where(spot * F.col("all") < (BLOCK // 4) * (1 << 20)).select("class", "first", "part")
    whole = blocks.select("part", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    own = placed.select("class", "first", "part", "band", "x")
    group = lambda df, asks, root: df.withColumns({"asks": F.lit(asks), "root": root})
    first = own.unionByName(seeds.join(small(whole), "part")).withColumns({"y": F.lit(0), "z": F.lit(0)})
    found = materialize(_meet(docs, group(first, True, F.col("class")), n, percent, order), "within")
    roots = connected_components(found)
    rooted = materialize(
        placed.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")),
        "rooted"
    )
    main = rooted.groupBy("part", "root").agg(F.sum("n").alias("size")).groupBy("part").agg(
        F.max_by("root", F.struct("size", "root")).alias("main")
    )
    outside = materialize(rooted.join(small(main), "part").where("root <> main").drop("main"), "outside")
    chunks = outside.groupBy("part", "band").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("chunks"))
    # groups: part, band and block of all classes (band, x), band and chunk of the outside ones (y, z)
    near = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.col("band") + d))
    every = rooted.select(
        "class", "first", "root", "part", "band", "x", near.alias("y")
    ).join(small(chunks.withColumnRenamed("band", "y")), ["part", "y"])
    every = every.select(
        "class", "first", "root", "part", "band", "x", "y", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("z"),
        F.lit(False).alias("asks")
    )
    asking = outside.join(small(chunks), ["part", "band"]).withColumn(
        "z", F.pmod(F.xxhash64("class", F.lit(9)), F.col("chunks")).cast("int")
    )
    asking = asking.select(
        "class", "first", "root", "part", F.col("band").alias("y"), "z", near.alias("band")
    ).join(small(blocks.select("part", "band", "blocks")), ["part", "band"])
    asking = asking.select(
        "class", "first", "root", "part", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), "y", "z",
        F.lit(True).alias("asks")
    )
    return found.unionByName(_meet(docs, every.unionByName(asking), n, percent, order))


def _joined(documents: DataFrame, n: int, percent: int, text_hash: Column | None) -> DataFrame:
    """The join; with a text_hash, also that and first_hash, the least of the component's rows that have its name for an id."""
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(named(docs if text_hash is None else docs.withColumn("text_hash", text_hash), n), "classes")
    hashed = [] if text_hash is None else ["head"]
    head = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("head")
    classes = rows.where("n > 0").groupBy("class").agg(
        F.min("doc_id").alias("first"), F.first("n").alias("n"), *([head] if hashed else [])
    )
    order = share(spark, frequencies(docs, n))
    near = connected_components(candidates(docs, n, percent, order))
    members = near.join(classes.select(F.col("class").alias("node"), "n", "first"), "node").select(
        F.col("node").alias("class"), F.col("root").alias("part"), "n", "first"
    )
    members = materialize(members, "members")
    wide = materialize(members.groupBy("part").agg(F.sum("n").alias("size")).where(F.col("size") > BLOCK).select("part"), "wide")
    if both_kinds(percent) and not wide.isEmpty():  # ranges may tell such a component's classes apart
        inside = materialize(members.join(small(wide), "part", "left_semi"), "inside")
        ranges = connected_components(candidates(_chosen(docs, inside), n, percent)).toDF("class", "two")
        inside = inside.join(ranges, "class", "left").withColumn("part", F.xxhash64("part", F.coalesce("two", "class")))
        members = members.join(small(wide), "part", "left_anti").unionByName(inside.select(members.columns))
        members = materialize(members, "split")
    # a class that is alone in its part links with nothing
    members = members.join(
        small(materialize(members.groupBy("part").count().where("count > 1").select("part"), "parts")), "part", "left_semi"
    )
    # bands of length: a link's two lengths are in the same or in neighbouring ones
    members = materialize(
        members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100))).cast("int")), "banded"
    )
    bands = members.groupBy("part", "band").agg(F.sum("n").alias("size"))
    large = materialize(
        bands.join(bands.groupBy("part").agg(F.sum("size").alias("all")).where(F.col("all") > BLOCK), "part"), "large"
    )
    beyond, zero = small(large.select("part").distinct()), F.lit(0)
    sizes = materialize(members.groupBy("part").agg(F.sum("n").alias("size")), "sizes")
    total = sizes.where(F.col("size") <= SMALL).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # small parts share a group: band 1, and part is the group's number
    shared = F.pmod(F.xxhash64("part", F.lit(3)), F.lit(max(1, -(-total // TOGETHER))))
    alone = members.join(beyond, "part", "left_anti").join(small(sizes), "part").withColumn("few", F.col("size") <= SMALL)
    alone = alone.select(
        "class", "first", F.when(F.col("few"), shared).otherwise(F.col("part")).alias("part"),
        F.col("few").cast("int").alias("band"), *(zero.alias(c) for c in "xyz"), F.lit(True).alias("asks"),
        F.col("class").alias("root")
    )
    edges = _meet(docs, alone, n, percent, order)
    if not large.isEmpty():
        edges = edges.unionByName(_large(docs, members.join(beyond, "part", "left_semi"), large, n, percent, order))
    final = connected_components(edges)
    ids = classes.select("class", "first", *hashed).join(
        final.select(F.col("node").alias("class"), "root"), "class", "left"
    ).withColumn("root", F.coalesce("root", "class"))
    least = ids.groupBy("root").agg(
        F.min("first").alias("component_id"), *(F.min(c).getField("text_hash").alias("first_hash") for c in hashed)
    )
    ids = ids.drop("head").join(least, "root").select("class", "component_id", *(["first_hash"] if hashed else []))
    shown = ["doc_id", "n_shingles", "component_id", *(["text_hash", "first_hash"] if hashed else [])]
    rows = rows.withColumnRenamed("n", "n_shingles")
    named_rows = rows.where("n_shingles > 0").join(ids, "class", "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    )
    empty = rows.where("n_shingles = 0").withColumns(
        {"component_id": F.col("doc_id")} | ({"first_hash": F.lit(None).cast("long")} if hashed else {})
    )
    return named_rows.select(shown).unionByName(empty.select(shown))
