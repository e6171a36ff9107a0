"""What the training-data operators share: tables in the shared folder, bounded Arrow batches, word hashing, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch between the JVM and a Python worker; a single longer row still passes whole.
BATCH_BYTES = 8 << 20
#: Rows and bytes of a table up to which it may be broadcast; callers have both checked before they broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20
#: Bytes of a text that are worked on at once; a longer text goes piece by piece, cut at white space.
PIECE = 1 << 20
#: Links up to which components are found in one task of an executor; more are contracted by grouped minima.
UNION_LINKS = 1_000_000
#: Bits of a sieve, whatever it holds (8 MB in each worker), and those that one task sets at once.
SIEVE_BITS, SIEVE_PART = 1 << 26, 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none: a local one on one machine, an error on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="allelia-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return str(found).rstrip("/")


#: What is to go at the end of each open scratch, innermost last: folders' paths and broadcasts.
_scratch: list[list] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared folder; it goes with the scratch it was made in, or when the driver ends."""
    path = f"{shared_dir(spark)}/allelia-{label}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    atexit.register(remove, spark, path)
    return path


def share(spark: SparkSession, value: object):
    """A broadcast of a value of bounded size; it goes with the scratch it was made in."""
    held = spark.sparkContext.broadcast(value)
    if _scratch:
        _scratch[-1].append(held)
    return held


@contextlib.contextmanager
def scratch(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Removes the folders and broadcasts made within; folders of the kept labels go to the scratch around it, if any."""
    made: list = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.remove(made)
        for x in made:
            if not isinstance(x, str):
                x.destroy()
            elif not any(f"/allelia-{label}-" in x for label in kept):
                remove(spark, x)
            elif _scratch:
                _scratch[-1].append(x)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_path named."""
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is None or jvm is None or spark.sparkContext._jsc.sc().isStopped():
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and any executor can be lost."""
    return _written(df, new_path(df.sparkSession, label))


#: Spark's setting by which a query's shuffle files go with its end, not with the driver's garbage, which may be much later.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> DataFrame:
    """df by way of a Parquet folder. What was shuffled for it goes at once, so the disk holds one step's files at a time."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches by bytes as well as rows, so that long texts don't fill a worker. Holds for plans that run from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What a worker keeps from task to task: the state of one operator.
_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]):
    """This worker's state of that key, which outlives its tasks; the state of any other key goes."""
    if key not in _kept:
        _kept.clear()
        give_back()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Returns freed memory, of which the allocators else keep what a task's largest batch took, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not all C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The function of batches, after whose end its worker gives back what the task has freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def _width(column: str, kind: T.DataType):
    """A column's bytes in each row, roughly."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(F.col(column)), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.size(F.col(column)), F.lit(0)) * (
            8 if not isinstance(kind.elementType, T.StructType) else 8 * len(kind.elementType.fields)
        ) + 16
    return F.lit(8)


def fits(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether df has at most so many rows and bytes; no more rows than that are looked at."""
    rows, size = BROADCAST_ROWS if rows is None else rows, BROADCAST_BYTES if size is None else size
    width = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(0))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()
    return found["n"] <= rows and found["b"] <= size


def small(df: DataFrame, rows: int | None = None, size: int | None = None) -> DataFrame:
    """df, marked for broadcast if it fits; else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df, rows, size) else df


def sieve(df: DataFrame):
    """A broadcast of bits that the column of longs sets, two each; see sifted. The driver sees SIEVE_BITS, however many there are."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_sieve_places(batch.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(at // SIEVE_PART), pa.array(at % SIEVE_PART)], names=["part", "at"])

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SIEVE_PART, bool)
        bits[frame["at"].to_numpy()] = True
        return pd.DataFrame({"part": frame["part"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    numbers = df.toDF("number").where("number IS NOT NULL")
    found = numbers.mapInArrow(places, "part long, at long").groupBy("part").applyInPandas(packed, "part long, bits binary")
    bits = np.zeros(SIEVE_BITS // 8, np.uint8)
    for r in found.collect():
        bits[r["part"] * SIEVE_PART // 8 :][: SIEVE_PART // 8] = np.frombuffer(r["bits"], np.uint8)
    return share(df.sparkSession, bits)


def _sieve_places(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = mix(numbers.astype(np.int64).view(np.uint64))
    return tuple(((found >> np.uint64(k)) % np.uint64(SIEVE_BITS)).astype(np.int64) for k in (0, 32))


def sifted(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which numbers may be among those that the sieve was made of; the others are not."""
    first, second = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 for at in _sieve_places(numbers))
    return (first & second).astype(bool)


def _matched(rows: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """The semi or anti join on these keys, null equal to null; other has these columns in this order, whatever their names.

    Where other is too large to broadcast, only rows that pass its sieve are shuffled; all others stay where they are. Of an anti
    join no row that has a match is shuffled either: keys alone tell which ones only the sieve takes for matched.
    """
    named = other.toDF(*(f"_g{k}" for k in range(len(keys)))).alias("o")
    same = F.lit(True)
    for k, name in enumerate(keys):
        same = same & F.col(f"k.{name}").eqNullSafe(F.col(f"o._g{k}"))
    if fits(other):
        return rows.alias("k").join(F.broadcast(named), same, how)
    held = sieve(other.select(F.xxhash64(*other.columns)))
    may = F.pandas_udf(lambda x: pd.Series(sifted(held.value, x.to_numpy())), "boolean")
    (mark,) = fresh(rows.columns, 1)
    typed = (F.col(name).cast(f.dataType) for name, f in zip(keys, other.schema.fields, strict=True))
    told = rows.withColumn(mark, may(F.xxhash64(*typed)))
    met = told.where(F.col(mark))
    if how == "left_semi":
        return met.alias("k").join(named.hint("merge"), same, how).drop(mark)
    spared = met.select(*keys).alias("k").join(named.hint("merge"), same, how).distinct()
    return told.where(~F.col(mark)).unionByName(_matched(met, materialize(spared, "spared"), keys, "left_semi")).drop(mark)


def among(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are in kept."""
    return _matched(rows, kept, keys, "left_semi")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys aren't in gone."""
    return _matched(rows, gone, keys, "left_anti")


def fresh(taken: list[str], n: int) -> list[str]:
    """n column names that aren't taken, whatever their case."""
    low = {c.lower() for c in taken}
    return [c for k in range(len(low) + n) if (c := f"_k{k}") not in low][:n]


def sliced(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column of texts holds about so many bytes in each; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
        group = (np.cumsum(lengths) - lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


# --- words and their 64-bit hashes, for whole blocks of texts at once ---

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LUT = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LUT_LOWER = _LUT.copy()
_LUT_LOWER[65:91] = _LUT[97:123]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


_LUT_BARE = np.where([chr(i).isalnum() or i > 127 for i in range(256)], _LUT_LOWER, np.uint64(0))


def words(texts: list[bytes], lower: bool = True, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all white-space-separated words of these UTF-8 texts: hash, text's number, start and end byte in the joined texts. bare: marks after a word don't count."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[buf], prepend=True))
    starts, ends = edge[::2], edge[1::2]
    forward, back = _power(len(buf))
    total = np.cumsum((_LUT_BARE if bare else _LUT_LOWER if lower else _LUT)[buf] * forward[: len(buf)], dtype=np.uint64)
    hashes = mix((total[ends - 1] - np.where(starts > 0, total[starts - 1], np.uint64(0))) * back[starts])
    offsets = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return hashes, np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def pieces(text: bytes, size: int | None = None) -> Iterator[bytes]:
    """A text in pieces of about so many bytes, cut before white space, so that no word is cut."""
    size, at = size or PIECE, 0
    while len(text) - at > size:
        cut = _BLANK.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def word_hashes(texts: list[bytes], lower: bool = True, bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text's number of all words; what a text takes beyond its words' hashes doesn't grow with its length."""
    if sum(map(len, texts)) <= 2 * PIECE:
        return words(texts, lower, bare)[:2]
    found = [[words([x], lower, bare)[0] for x in pieces(t)] for t in texts]
    counts = [sum(map(len, x)) for x in found]
    return np.concatenate([np.zeros(0, np.uint64), *(x for each in found for x in each)]), np.repeat(np.arange(len(texts)), counts)


def shingles(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text's number of every k words in a row; a text of fewer words gives the whole sequence as one."""
    n = len(hashes)
    sums = mix(
        np.uint64(k) + sum(
            ((mix(hashes[i : max(i, n - k + 1 + i)] + np.uint64(i))) * np.uint64(2 * i + 3) for i in range(k)),
            np.zeros(max(0, n - k + 1), np.uint64)
        )
    )
    whole = doc[: max(0, n - k + 1)] == doc[k - 1 :] if n >= k else np.zeros(0, bool)
    out, of = sums[whole], doc[: len(whole)][whole]
    numbers, first, count = np.unique(doc, return_index=True, return_counts=True)
    short = count < k
    if short.any():
        extra = [
            mix(np.uint64(c) + sum(mix(hashes[f + i : f + i + 1] + np.uint64(i)) * np.uint64(2 * i + 3) for i in range(c)))[0]
            for f, c in zip(first[short], count[short], strict=True)
        ]
        out, of = np.concatenate([out, np.array(extra, np.uint64)]), np.concatenate([of, numbers[short]])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these links and the smallest node of each one's component, by pointer jumping over whole arrays."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        for side in (x, y):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return nodes, nodes[root]


def connected_components(edges: DataFrame, rounds: int = 60, links: int | None = None) -> DataFrame:
    """(node, root) with the smallest node of each component as root, from long columns a and b.

    Up to UNION_LINKS distinct links, which are counted first, go to one task. Beyond, large-star and small-star steps in
    turn, each a grouped minimum (combined before the shuffle) and a join with one row per node, whose skewed partitions
    are split at run time, until the stars are stable. Every step's links are written to the shared folder and the step
    before goes, so no lineage grows and nothing reaches the driver but two sums.
    """
    spark = edges.sparkSession
    pairs = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    if pairs.limit((UNION_LINKS if links is None else links) + 1).count() <= (UNION_LINKS if links is None else links):

        def whole(frame: pd.DataFrame) -> pd.DataFrame:
            node, root = _forest(frame["u"].to_numpy(), frame["v"].to_numpy())
            return pd.DataFrame({"node": node, "root": root})

        return materialize(pairs.groupBy(F.lit(0).alias("all")).applyInPandas(whole, "node long, root long"), "components")
    seen, old = None, None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").select(
            F.explode(
                F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
            ).alias("e")
        ).select("e.*").where("u <> v").distinct()
        path = new_path(spark, "stars")
        pairs = _written(linked, path)
        if old:
            remove(spark, old)
        old = path
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())  # a count and a sum
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
