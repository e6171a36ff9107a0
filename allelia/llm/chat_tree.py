"""Chat formatting as prefix trees: conversations that share their first turns are merged, and shared text is emitted once.

A node is a turn after a given history; its key is a chained hash of all turns so far. Nodes in depth-first order make one
long character stream of each tree (all conversations with the same first turn). Every node carries its offset in that
stream, the position ids of its characters (its history's length onwards) and the stream intervals of its ancestors that
it may attend to, besides itself, causally. A node's place follows from sorting by the path of its branches (8 bytes of
the key at each fork), so no tree is ever gathered in one task: offsets are running sums over range-sorted partitions
with carried totals.

Reading back takes a conversation's last node alone: its intervals and itself are cut out of the stream, which is laid out
in pages of PAGE characters with the ranges of the loss mask, and put together in order of position. A wrong offset,
interval, position or mask gives another text, or an error.

The template writes a turn as START role newline text END. The control strings are escaped inside roles and texts,
reversibly: every one of them begins with `<|`, and any `<|` of a text becomes `<\\|`, any backslash run between
`<` and `|` one longer. The loss mask covers the texts of assistant turns.

Defined results: a null text or role is empty; turns go by turn (nulls first), then role, then text, so repeated rows are
repeated turns; rows of a null conv_id belong to one conversation of null id; a conversation of no rows doesn't exist; an
empty table gives no rows; further columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, small

# The control strings.
START, BREAK, END = "<|turn|>", "\n", "<|end|>"
ASSISTANT = "assistant"
#: Characters of a page of the stream.
PAGE = 4096


def escape(text: str) -> str:
    """No control string is left in it; unescape gives the text back."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "<" in text else text


def segment(role: str, text: str) -> str:
    """A turn as the template writes it. In a role, backslashes are doubled and line breaks written as backslash n."""
    return START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + BREAK + escape(text) + END


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a segment."""
    if not (piece.startswith(START) and piece.endswith(END)):
        raise ValueError("not a segment")
    role, _, text = piece[len(START) : -len(END)].partition(BREAK)
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S), unescape(text)


def by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    """Each conversation's rows in one partition, one after the other; a long conversation is sorted on disk and streamed."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _emit(columns: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(columns), columns, strict=True)],
        names=[n for n, _ in columns]
    )


def chained(turns: DataFrame) -> DataFrame:
    """conv_id, pos, key, parent, root, start (characters of the history), segment, loss_from, loss_to (in the segment)."""
    columns = [
        ("conv_id", pa.int64()), ("pos", pa.int64()), ("key", pa.string()), ("parent", pa.string()), ("root", pa.string()),
        ("start", pa.int64()), ("segment", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())
    ]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pos, key, root, start = object(), 0, "", "", 0
        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv_id != at:
                    at, pos, key, root, start = conv_id, 0, "", "", 0
                piece = segment(role, text)
                parent, key = key, hashlib.blake2b(f"{key}{piece}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                root = root or key
                first = piece.index(BREAK) + 1 if role == ASSISTANT else 0
                rows.append(
                    (conv_id, pos, key, parent, root, start, piece, first, len(piece) - len(END) if role == ASSISTANT else 0)
                )
                pos, start = pos + 1, start + len(piece)
            yield _emit(columns, rows)

    plain = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    bounded_batches(turns.sparkSession)
    return by_conversation(plain, "turn", "role", "text").mapInArrow(
        chain,
        "conv_id long, pos long, key string, parent string, root string, start long, segment string, loss_from long, loss_to long"
    )


def merge(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: the conversations' turns (conv_id, pos, key) and the tree's nodes, each emitted once in depth-first order.

    Nodes: key, root, pos, start (first position id), offset (in the stream), segment, loss_from, loss_to and intervals,
    the ancestors' (from, to) in the stream, adjoining ones made one.
    """
    spark = turns.sparkSession
    rows = materialize(chained(turns), "turns")
    forks = rows.where("parent <> ''").groupBy("parent").agg(F.count_distinct("key").alias("n")).where("n > 1").select(
        "parent", F.lit(True).alias("fork")
    )
    # first turns, which all have the same empty history, go round the join
    first = rows.where("parent = ''").withColumn("fork", F.lit(None).cast("boolean"))
    flagged = rows.where("parent <> ''").join(
        small(materialize(forks, "forks")), "parent", "left"
    ).select(first.columns).unionByName(first)
    node = ["key", "root", "pos", "start", "segment", "loss_from", "loss_to"]
    columns = [
        ("key", pa.string()), ("root", pa.string()), ("pos", pa.int64()), ("start", pa.int64()), ("segment", pa.string()),
        ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("path", pa.list_(pa.int64()))
    ]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, path = object(), []
        for batch in batches:
            out = []
            for conv_id, fork, *rest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "fork", *node)), strict=True):
                if conv_id != at:
                    at, path = conv_id, []
                if fork:
                    path = [*path, int(rest[0][:16], 16) - (1 << 63)]
                out.append((*rest, path))
            yield _emit(columns, out)

    types = "key string, root string, pos long, start long, segment string, loss_from long, loss_to long"
    walked = by_conversation(flagged.select("conv_id", "fork", *node), "pos").mapInArrow(walk, types + ", path array<long>")
    unique = walked.groupBy("key").agg(*(F.first(c).alias(c) for c in (*node[1:], "path")))
    # depth-first: by tree, by branches taken, by depth; running lengths within a partition, whole partitions' totals carried
    sorted_ = unique.repartitionByRange(
        max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "root", "path", "pos"
    ).sortWithinPartitions("root", "path", "pos")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in node), strict=True):
                out.append((*row, part, total))
                total += len(row[4])
            yield _emit([*columns[:7], ("part", pa.int64()), ("local", pa.int64())], out)

    laid = materialize(sorted_.mapInArrow(lay, types + ", part long, local long"), "laid")
    sums = {
        r["part"]: r["n"] for r in laid.groupBy("part").agg(F.sum(F.length("segment")).alias("n")).collect()
    }  # a row per partition
    before, carried = 0, []
    for part in sorted(sums):
        carried.append((part, before))
        before += sums[part]
    carry = F.broadcast(spark.createDataFrame(carried, "part long, before long"))
    placed = laid.join(carry, "part").withColumn("offset", F.col("before") + F.col("local")).drop("part", "local", "before")

    def attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, spans = object(), []
        for batch in batches:
            out = []
            for conv_id, key, offset, size in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "key", "offset", "size")), strict=True
            ):
                if conv_id != at:
                    at, spans = conv_id, []
                out.append((key, [{"from": a, "to": b} for a, b in spans]))
                if spans and spans[-1][1] == offset:
                    spans = [*spans[:-1], (spans[-1][0], offset + size)]
                else:
                    spans = [*spans, (offset, offset + size)]
            yield _emit([("key", pa.string()), ("intervals", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))], out)

    members = rows.select("conv_id", "pos", "key")
    ranges = by_conversation(
        members.join(
            placed.select("key", "offset", F.length("segment").cast("long").alias("size")), "key"
        ).select("conv_id", "pos", "key", "offset", "size"),
        "pos"
    )
    seen = ranges.mapInArrow(
        attend, "key string, intervals array<struct<from: bigint, to: bigint>>"
    ).groupBy("key").agg(F.first("intervals").alias("intervals"))
    return members, materialize(placed.join(seen, "key"), "nodes")


def pages(nodes: DataFrame, size: int = 0) -> DataFrame:
    """page, text, losses of the emitted stream: its characters in pages of `size`, and the loss mask's (from, to) in each."""
    size = size or PAGE
    ends = nodes.withColumn("end", F.col("offset") + F.length("segment"))
    numbers = F.sequence(F.floor(F.col("offset") / size), F.floor((F.col("end") - 1) / size))
    piece = ends.select("*", F.explode(numbers).alias("page")).withColumns(
        {"a": F.greatest("offset", F.col("page") * size), "b": F.least("end", (F.col("page") + 1) * size)}
    )
    low, high = F.greatest(
        F.col("a"), F.col("offset") + F.col("loss_from")
    ), F.least(F.col("b"), F.col("offset") + F.col("loss_to"))
    cut = piece.select(
        "page", "a",
        F.substring("segment", (F.col("a") - F.col("offset") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")).alias("t"),
        F.when((F.col("loss_to") > F.col("loss_from")) & (low < high), F.struct(low.alias("from"), high.alias("to"))).alias("loss")
    )
    each = cut.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("a", "t", "loss"))).alias("p"))
    return each.select(
        "page", F.concat_ws("", F.col("p.t")).alias("text"), F.filter(F.col("p.loss"), lambda x: x.isNotNull()).alias("losses")
    )


def read_back(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per conversation, from the emitted stream: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_intervals."""
    columns = [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_intervals", pa.int64())
    ]

    class Reader:
        """What is read of one conversation."""

        def __init__(self, conv_id, n: int) -> None:
            self.id, self.n, self.turns, self.chars, self.masked = conv_id, n, 0, 0, 0
            self.whole, self.loss, self.open, self.marks = hashlib.sha256(), hashlib.sha256(), "", []

        def add(self, text: str, losses: list[tuple[int, int]]) -> None:
            self.marks += [(a + len(self.open), b + len(self.open)) for a, b in losses]
            self.open += text
            self.chars += len(text)
            while (end := self.open.find(END)) >= 0:
                end += len(END)
                role, said = parse(self.open[:end])
                mask = unescape("".join(self.open[a : min(b, end)] for a, b in self.marks if a < end))
                self.turns += 1
                self.whole.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                self.loss.update(mask.encode("utf-8", "surrogatepass"))
                self.masked += len(mask)
                self.open, self.marks = self.open[end:], [(max(a - end, 0), b - end) for a, b in self.marks if b > end]

        def told(self) -> tuple:
            if self.open:
                raise ValueError(f"conversation {self.id}: the stream ends inside a turn")
            return self.id, self.turns, self.whole.hexdigest(), self.masked, self.loss.hexdigest(), self.chars, self.n

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for conv_id, position, text, losses, n in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "position", "text", "losses", "n")), strict=True
            ):
                if now is None or conv_id != now.id:
                    out += [now.told()] if now else []
                    now = Reader(conv_id, n)
                if position != now.chars:
                    raise ValueError(f"conversation {conv_id}: position {position} follows {now.chars} characters")
                now.add(text, [(x["from"], x["to"]) for x in losses])
            yield _emit(columns, out)
        if now:
            yield _emit(columns, [now.told()])

    last = members.groupBy("conv_id").agg(F.max_by("key", "pos").alias("key"))
    ends = last.join(nodes, "key").select(
        "conv_id", "intervals", "start", "offset", (F.col("offset") + F.length("segment")).alias("end")
    )
    own = F.array(F.struct(F.col("offset").alias("from"), F.col("end").cast("long").alias("to")))
    # a conversation's positions: those of its ancestors, one interval after the other, then its own from `start` on
    before = F.transform(
        F.sequence(F.lit(0), F.size("intervals")),
        lambda i: F.aggregate(F.slice("intervals", F.lit(1), i), F.lit(0).cast("long"), lambda x, y: x + y["to"] - y["from"])
    )
    asked = ends.select(
        "conv_id", F.size("intervals").cast("long").alias("n"), "start", F.concat("intervals", own).alias("all"),
        before.alias("before")
    )
    asked = asked.select("conv_id", "n", "start", F.posexplode("all").alias("k", "r"), "before").select(
        "conv_id", "n", "r", F.when(F.col("k") == F.col("n"), F.col("start")).otherwise(F.col("before")[F.col("k")]).alias("first")
    )
    sheet = asked.select(
        "*", F.explode(F.sequence(F.floor(F.col("r.from") / PAGE), F.floor((F.col("r.to") - 1) / PAGE))).alias("page")
    )
    a, b, head = F.greatest(F.col("r.from"), F.col("page") * PAGE), F.least(
        F.col("r.to"), (F.col("page") + 1) * PAGE
    ), F.col("page") * PAGE
    read = sheet.join(pages(nodes), "page").select(
        "conv_id", (F.col("first") + a - F.col("r.from")).alias("position"),
        F.substring("text", (a - head + 1).cast("int"), (b - a).cast("int")).alias("text"), "losses", a.alias("a"), b.alias("b"),
        "n"
    )
    mine = F.transform(
        F.filter("losses", lambda x: (x["from"] < F.col("b")) & (x["to"] > F.col("a"))),
        lambda x: F.struct(
            (F.greatest(x["from"], F.col("a")) - F.col("a")).alias("from"), (F.least(x["to"], F.col("b")) - F.col("a")).alias("to")
        )
    )
    bounded_batches(members.sparkSession)
    return by_conversation(read.select("conv_id", "position", "text", mine.alias("losses"), "n"), "position").mapInArrow(
        digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_intervals long"
    )
