"""Benchmark decontamination by SimHash: item-sized windows, a multi-index over Hamming blocks, exact verification.

Words are runs of letters and digits, lower-cased; a shingle is five words in a row. A window of as many words as an item
has is fingerprinted with 64 bits, each the majority of that bit among its shingles' hashes, repeats counted. Windows
start where a shingle of an item of that size occurs: among windows around a passage a best one starts so, and a window
without any has similarity 0. A fingerprint is cut into 8 blocks of 8 bits. Of two fingerprints at most RADIUS = 23 bits
apart, some block differs in at most 2 bits, so the index of the items' blocks, with all values up to 2 bits away, finds
every item within the radius. Candidates are verified by the weighted Jaccard similarity of their shingles (weights are
counts): SIMILAR or more is a leak.

All is built-in column functions. The search for starts is narrow: a row is a text's key, a place and one hash. The items'
shingles, index and counts are measured and broadcast only within common.BROADCAST_ROWS and BROADCAST_BYTES; otherwise
the same joins shuffle, the starts of a text are gathered (at most one per word) and the text's hashes are joined once.
The index holds an item's number, size and fingerprint; the items' shingles come in after the radius test alone.

Defined results: null or short texts have no windows; items of under five words have no shingle and match nothing; an item
of over PART words is matched by parts of PART words, any of which counts: consecutive ones and its last PART words; of
equally similar windows the first that starts with a shingle of an item of that size is told, which may lie a few words
after a window as similar that starts with none; rows that share an id are reported as one; a null doc_id is reported as
null; empty tables give no rows; further columns, whatever their names, are kept by `keep_clean`, which judges each row
by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, fresh, materialize, small

SHINGLE = 5
SIMILAR = 0.8
RADIUS, BLOCKS, NEAR = 23, 8, 2
PART = 4096
_MASKS = [m for m in range(256) if m.bit_count() <= NEAR]
_LANES = 0x0001000100010001


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column) -> Column:
    """64-bit hashes of every SHINGLE words in a row."""
    each = F.transform(
        F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(*(F.get(w, i + (k - 1)) for k in range(SHINGLE)))
    )
    return F.when(F.size(w) >= SHINGLE, each).otherwise(F.array().cast("array<bigint>"))


def lanes(hashes: Column) -> list[Column]:
    """16 sums, of which number k counts the set bits k, k + 16, k + 32 and k + 48 in four lanes of 16 bits."""

    def lane(k: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES)))

    return [lane(k) for k in range(16)]


def with_fingerprint(df: DataFrame, hashes: str) -> DataFrame:
    """Adds fp: bit b is set if more than half of the hashes have it."""
    df = df.withColumn("_sums", F.array(*lanes(F.col(hashes))))
    bits = F.lit(0).cast("long")
    for b in range(64):
        count = F.shiftrightunsigned(F.col("_sums")[b % 16], 16 * (b // 16)).bitwiseAND(F.lit(0xFFFF))
        bits = bits.bitwiseOR(
            F.when(count * 2 > F.size(hashes), F.lit((1 << b) - (1 << 64) * (b == 63))).otherwise(F.lit(0)).cast("long")
        )
    return df.withColumn("fp", bits).drop("_sums")


def block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255)).cast("int")


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, w (words), sh (shingle hashes), fp of every item, or part of a long one."""
    w = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("words")
    ).where(F.size("words") >= SHINGLE)
    parts = w.select(
        "item_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size("words") - 1) / PART).cast("int")),
                lambda i: F.slice("words", F.least(i * PART, F.greatest(F.size("words") - PART, F.lit(0))) + 1, PART)
            )
        ).alias("words")
    )
    sh = parts.where(F.size("words") >= SHINGLE).select("item_id", F.size("words").alias("w"), shingles(F.col("words")).alias("sh"))
    return with_fingerprint(sh, "sh")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word of each benchmark item in each document: the most similar window (see Defined results)."""
    return _leaks(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, ["doc_id"]
    )


def _starts(hashed: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sh, pos, sizes of every place where a text has a shingle of an item; sizes are these items' word counts."""
    # outer, for the filter that Spark would infer evaluates every text's words anew for each shingle; the join drops the nulls
    if fits(anchors):
        return hashed.select(
            "*", F.posexplode_outer("sh").alias("pos", "h")
        ).join(F.broadcast(anchors), "h").select(*keys, "sh", "pos", "sizes")
    named = hashed.withColumn("_own", F.xxhash64("sh"))
    mine = [*keys, "_own"]
    found = named.select(
        *mine, F.posexplode_outer("sh").alias("pos", "h")
    ).join(anchors, "h").select(*mine, "pos", "sizes").distinct()
    places = found.groupBy(*mine).agg(F.collect_list(F.struct("pos", "sizes")).alias("at")).toDF(*(f"_of_{c}" for c in mine), "at")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in mine]
    return named.join(places, same).select(*keys, "sh", F.explode("at").alias("at")).select(*keys, "sh", "at.pos", "at.sizes")


def _leaks(docs: DataFrame, benchmark: DataFrame, keys: list[str]) -> DataFrame:
    """The leaks of texts that are told apart by other columns, the keys."""
    known = materialize(items(benchmark).withColumn("item", F.monotonically_increasing_id()), "items")
    anchors = materialize(
        known.select("w", F.explode("sh").alias("h")).groupBy("h").agg(F.collect_set("w").alias("sizes")), "anchors"
    )
    index = known.select(
        "w", "item", F.col("fp").alias("item_fp"),
        F.posexplode(F.array(*(block(F.col("fp"), k) for k in range(BLOCKS)))).alias("block", "exact")
    )
    index = index.withColumn(
        "value", F.explode(F.transform(F.array(*map(F.lit, _MASKS)), lambda m: F.col("exact").bitwiseXOR(m)))
    ).drop("exact")
    counts = F.transform(
        F.array_distinct("sh"), lambda h: F.named_struct(F.lit("h"), h, F.lit("c"), F.size(F.filter("sh", lambda x: x == h)))
    )
    told = known.select("item", "item_id", counts.alias("item_sh"), F.size("sh").alias("item_n"))
    hashed = docs.select(*keys, words(F.col("text")).alias("words")).select(*keys, shingles(F.col("words")).alias("sh"))
    windows = _starts(hashed, anchors, keys).select(*keys, "pos", F.explode("sizes").alias("w"), "sh").select(
        *keys, "pos", "w", F.slice("sh", F.col("pos") + 1, F.col("w") - (SHINGLE - 1)).alias("win")
    )
    # a window that can't reach the similarity, cut short by the text's end, is left out
    windows = with_fingerprint(windows.where(F.size("win") >= SIMILAR * (F.col("w") - (SHINGLE - 1))), "win")
    asked = windows.select("*", F.posexplode(F.array(*(block(F.col("fp"), k) for k in range(BLOCKS)))).alias("block", "value"))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*(F.when(F.bit_count(block(apart, k)) <= NEAR, k) for k in range(BLOCKS)))
    near = asked.join(small(index), ["w", "block", "value"]).where(
        (F.bit_count(apart) <= RADIUS) & (first == F.col("block"))
    ).select(*keys, "pos", "win", "item").join(small(told), "item")
    both = F.aggregate("item_sh", F.lit(0), lambda a, e: a + F.least(e["c"], F.size(F.filter("win", lambda x: x == e["h"]))))
    scored = near.select(*keys, "item_id", "pos", both.alias("both"), (F.size("win") + F.col("item_n")).alias("n"))
    scored = scored.withColumn("similarity", F.col("both") / (F.col("n") - F.col("both"))).where(F.col("similarity") >= SIMILAR)
    best = scored.groupBy(*keys, "item_id").agg(F.max(F.struct("similarity", (-F.col("pos")).alias("back"))).alias("b"))
    return best.select(
        *keys, "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).cast("long").alias("start_word")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns; rows that share an id, or have none, are told apart by their text's hash."""
    own, text = docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))
    found = _leaks(
        docs.select(own.alias("doc_id"), text.alias("hash"), docs["text"].cast("string").alias("text")), benchmark,
        ["doc_id", "hash"]
    )
    gone = small(materialize(found.select("doc_id", "hash").distinct().toDF(*fresh(docs.columns, 2)), "leaks"))
    return docs.join(gone, own.eqNullSafe(gone[gone.columns[0]]) & (text == gone[gone.columns[1]]), "left_anti")
