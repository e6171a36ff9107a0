"""PLINK 1 binary filesets: BIM and FAM tables, and a data source that decodes BED variant ranges in parallel.

`spark.read.format("plink_bed").option("prefix", p).load()` gives one row per variant: its BIM columns and `calls`, the
variant's packed two-bit genotypes. Options: samples (comma-separated positions; calls are then repacked for these),
chrom, start and stop (variant_index range), variants_per_partition, or tasks (partitions to aim at). Filters on chrom and
variant_index are pushed down and prune partitions. Dosage counts the second allele column's allele: codes 00, 10, 11 are
0, 1, 2, and 01 is missing. The prefix is a path that every executor can open, or one with a scheme that Arrow has a file
system for (see files). The planner reads the BIM once and gives each partition the place of its lines, so a task reads
its own variants alone.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .files import absolute, open_binary, replacing

# Fixed values of the format: the header, and each code's dosage.
MAGIC = b"\x6c\x1b\x01"
DOSAGE = np.array([0, np.nan, 1, 2])
BIM = "variant_index long, chrom string, snp string, cm double, pos long, a0 string, a1 string"
FAM = "sample_index int, fid string, iid string, father string, mother string, sex int, pheno double"
VARIANTS = "variant_index long, chrom string, snp string, pos long, calls binary"
#: Variants of a partition where the caller doesn't say how many: so that there is work for all cores, within these bounds.
LEAST_VARIANTS, MOST_VARIANTS = 256, 8192
_TABLE = np.stack([DOSAGE[(np.arange(256) >> (2 * k)) & 3] for k in range(4)], 1)


def _ordered_lines(path: str) -> Iterator[tuple[int, list[bytes]]]:
    """Place and cells of every line that isn't blank."""
    at = 0
    with open_binary(path) as f:
        while block := f.read(1 << 22):
            while not block.endswith(b"\n") and (more := f.read(1 << 12)):
                block += more
                if b"\n" in more:
                    keep = block.rindex(b"\n") + 1
                    f.seek(at + keep)
                    block = block[:keep]
            for line in block.splitlines(keepends=True):
                if cells := line.split():
                    yield at, cells
                at += len(line)


def read_bim(spark: SparkSession, prefix: str) -> DataFrame:
    """Variants in file order: BIM's six columns after variant_index."""
    return _ordered(spark, f"{prefix}.bim", ["string", "string", "double", "long", "string", "string"], BIM)


def read_fam(spark: SparkSession, prefix: str) -> DataFrame:
    """Samples in file order."""
    return _ordered(spark, f"{prefix}.fam", ["string", "string", "string", "string", "int", "double"], FAM)


def _ordered(spark: SparkSession, path: str, types: list[str], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    # file order: each partition's rows keep it, and partitions of a text file are in order of their offset
    parts = lines.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for r in parts:
        starts.append((r["part"], before))
        before += r["n"]
    offset = F.element_at(
        F.create_map(*(F.lit(x) for pair in starts for x in pair)), F.shiftright("at", 33)
    ) if starts else F.lit(0)
    cells = F.split(F.trim("value"), r"\s+")
    index = (offset + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long" if names[0] == "variant_index" else "int")
    return lines.select(
        index.alias(names[0]),
        *(F.try_element_at(cells, F.lit(i + 1)).try_cast(t).alias(n) for i, (t, n) in enumerate(zip(types, names[1:], strict=True)))
    )


class BedFile:
    """Random access to a BED file's variants."""

    def __init__(self, prefix: str):
        self.path = f"{prefix}.bed"
        self.n = sum(1 for _ in _ordered_lines(f"{prefix}.fam"))
        self.width = (self.n + 3) // 4
        with open_binary(self.path) as f:
            head = f.read(3)
            size = f.seek(0, 2)
        if head[:2] != MAGIC[:2]:
            raise ValueError(f"{self.path} is not a PLINK 1 BED file")
        if head[2:] != MAGIC[2:]:
            raise ValueError(f"{self.path} is sample-major; only variant-major files are read")
        self.m = (size - 3) // max(self.width, 1)

    def packed(self, start: int, stop: int) -> np.ndarray:
        """Bytes of variants start to stop, one row each."""
        with open_binary(self.path) as f:
            f.seek(3 + start * self.width)
            data = np.frombuffer(f.read((stop - start) * self.width), np.uint8)
        return data.reshape(-1, self.width)


def pack(codes: np.ndarray) -> np.ndarray:
    """Rows of two-bit codes as bytes, the first sample in the low bits."""
    m, n = codes.shape
    full = np.zeros((m, (n + 3) // 4 * 4), np.uint8)
    full[:, :n] = codes
    quads = full.reshape(m, -1, 4)
    return (quads[..., 0] | quads[..., 1] << 2 | quads[..., 2] << 4 | quads[..., 3] << 6).astype(np.uint8)


def unpack(packed: np.ndarray, n: int, samples: np.ndarray | None = None) -> np.ndarray:
    """Dosages, variants by samples, NaN if missing; with samples, only their bytes are looked at."""
    if samples is None:
        return _TABLE[packed].reshape(len(packed), -1)[:, :n]
    samples = np.asarray(samples, np.int64)
    if len(samples) and (samples.min() < 0 or samples.max() >= n):
        raise IndexError("a sample's position lies outside the fileset")
    return DOSAGE[(packed[:, samples // 4] >> (2 * (samples % 4)).astype(np.uint8)) & 3]


def dosages(calls: list[bytes], n: int, samples: np.ndarray | None = None) -> np.ndarray:
    """Dosages of packed calls, one row per variant."""
    return unpack(
        np.frombuffer(b"".join(calls), np.uint8).reshape(len(calls), -1), n, samples
    ) if calls else np.zeros((0, n if samples is None else len(samples)))


class Range(InputPartition):
    """Variants start to stop, and the place of start's line in the BIM file."""

    def __init__(self, start: int, stop: int, line: int):
        self.start, self.stop, self.line = start, stop, line


class BedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.prefix = options["prefix"]
        self.bed = BedFile(self.prefix)
        self.samples = [int(x) for x in options["samples"].split(",")] if options.get("samples") else None
        self.step = int(options["variants_per_partition"]) if options.get("variants_per_partition") else None
        self.tasks = int(options.get("tasks", 1))
        self.start, self.stop = int(options.get("start", 0)), min(int(options.get("stop", self.bed.m)), self.bed.m)
        self.chroms = {options["chrom"]} if options.get("chrom") else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("chrom",) and isinstance(f, EqualTo | In):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.chroms = wanted if self.chroms is None else self.chroms & wanted
            elif column == ("variant_index",) and isinstance(f, GreaterThanOrEqual | GreaterThan):
                self.start = max(self.start, f.value + isinstance(f, GreaterThan))
            elif column == ("variant_index",) and isinstance(f, LessThan | LessThanOrEqual):
                self.stop = min(self.stop, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Range]:
        """Runs of wanted variants from one reading of the BIM: at most `step` in each, or as many as make `tasks` of them."""
        numbers, lines = array("q"), array("q")
        wanted = None if self.chroms is None else {str(c).encode() for c in self.chroms}
        for k, (at, cells) in enumerate(_ordered_lines(f"{self.prefix}.bim")):
            if k >= self.stop:
                break
            if k >= self.start and (wanted is None or cells[0] in wanted):
                numbers.append(k)
                lines.append(at)
        step = self.step or min(max(-(-len(numbers) // self.tasks), LEAST_VARIANTS), MOST_VARIANTS)
        out: list[Range] = []
        for k, at in zip(numbers, lines, strict=True):
            if out and out[-1].stop == k and k - out[-1].start < step:
                out[-1].stop = k + 1
            else:
                out.append(Range(k, k + 1, at))
        return out

    def _bim(self, partition: Range) -> list[list[bytes]]:
        rows: list[list[bytes]] = []
        with open_binary(f"{self.prefix}.bim") as f:
            f.seek(partition.line)
            rest = b""
            while len(rows) < partition.stop - partition.start:
                block = f.read(1 << 20)
                lines = (rest + block).split(b"\n")
                rest = lines.pop() if block else b""
                rows += [cells for line in lines if (cells := line.split())]
                if not block:
                    break
        return rows

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        bim = self._bim(partition)
        for a in range(partition.start, partition.stop, 1024):
            packed = self.bed.packed(a, min(a + 1024, partition.stop))
            if self.samples is not None:
                picked = np.array(self.samples)
                packed = pack((packed[:, picked // 4] >> (2 * (picked % 4)).astype(np.uint8)) & 3)
            rows = bim[a - partition.start : a - partition.start + len(packed)]
            cells = [[r[c].decode() for r in rows] for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(a, a + len(packed)), pa.int64()), *map(pa.array, cells),
                    pa.array([int(r[3]) for r in rows], pa.int64()), pa.array([x.tobytes() for x in packed], pa.binary())
                ],
                names=["variant_index", "chrom", "snp", "pos", "calls"]
            )


class BedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plink_bed"

    def schema(self) -> str:
        return VARIANTS

    def reader(self, schema) -> BedReader:
        return BedReader(dict(self.options))


def read_bed(spark: SparkSession, prefix: str, **options: object) -> DataFrame:
    """The variants of a fileset with their packed calls."""
    BedFile(prefix)  # a bad header fails here, not in a task
    spark.dataSource.register(BedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("plink_bed").option("prefix", absolute(prefix)).option(
        "tasks", str(spark.sparkContext.defaultParallelism)
    )
    for k, v in options.items():
        reader = reader.option(k, ",".join(map(str, v)) if isinstance(v, list | tuple) else str(v))
    return reader.load()


def call(calls: Column, sample: Column) -> Column:
    """One sample's dosage from packed calls, in SQL's integer operations; null if missing."""
    byte = F.conv(F.hex(F.substring(calls, F.floor(sample / 4).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    code = F.floor(byte / F.pow(F.lit(4), sample % 4)).cast("int").bitwiseAND(F.lit(3))
    return F.when(code == 0, 0).when(code == 2, 1).when(code == 3, 2).cast("tinyint")


def to_long(variants: DataFrame, n: int) -> DataFrame:
    """(variant_index, chrom, snp, pos, sample_index, dosage) of every call: the relational form."""
    each = variants.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.select(
        "variant_index", "chrom", "snp", "pos", "sample_index", call(F.col("calls"), F.col("sample_index")).alias("dosage")
    )


def to_blocks(genotypes: DataFrame, n: int) -> DataFrame:
    """The packed form of (variant_index, chrom, snp, pos, sample_index, dosage) rows; absent calls are missing."""
    schema = VARIANTS

    def packed(frame):
        import pandas as pd

        codes = np.ones((1, n), np.uint8)
        known = frame["dosage"].notna().to_numpy()
        codes[0, frame["sample_index"].to_numpy()[known]] = np.array([0, 2, 3], np.uint8)[
            frame["dosage"].to_numpy()[known].astype(int)
        ]
        head = frame.iloc[0]
        return pd.DataFrame(
            {
                "variant_index": [head["variant_index"]], "chrom": [head["chrom"]], "snp": [head["snp"]], "pos": [head["pos"]],
                "calls": [pack(codes)[0].tobytes()]
            }
        )

    return genotypes.select(
        "variant_index", "chrom", "snp", "pos", "sample_index", F.col("dosage").cast("double").alias("dosage")
    ).groupBy("variant_index").applyInPandas(packed, schema)


def write_fileset(variants: DataFrame, iids: list[str], prefix: str, a0: str = "A", a1: str = "G") -> str:
    """Writes packed variants (variant_index, chrom, snp, pos, calls) as a fileset, in order of variant_index.

    The rows come sorted through the driver, one partition at a time, so no more than a partition is held.
    """
    rows = variants.select("variant_index", "chrom", "snp", "pos", "calls").orderBy("variant_index")
    with replacing(f"{prefix}.bed") as bed, replacing(f"{prefix}.bim") as bim, replacing(f"{prefix}.fam") as fam:
        bed.write(MAGIC)
        for r in rows.toLocalIterator():
            bed.write(bytes(r["calls"]))
            bim.write(f"{r['chrom']}\t{r['snp']}\t0\t{r['pos']}\t{a0}\t{a1}\n".encode())
        fam.write("".join(f"{i}\t{i}\t0\t0\t0\t-9\n" for i in iids).encode())
    return prefix


def write_plink(
    prefix: str, dosage: np.ndarray, iids: list[str], chroms: list[str], positions: list[int], a0: str = "A", a1: str = "G",
    snps: list[str] | None = None
) -> None:
    """Writes samples-by-variants dosages (NaN: missing) as a fileset."""
    dosage = np.asarray(dosage, float).T
    codes = np.where(np.isnan(dosage), 1, np.array([0, 2, 3])[np.nan_to_num(dosage).astype(int)]).astype(np.uint8)
    Path(f"{prefix}.bed").write_bytes(MAGIC + pack(codes).tobytes())
    names = snps or [f"rs{i}" for i in range(len(dosage))]
    Path(f"{prefix}.bim").write_text(
        "".join(f"{c}\t{s}\t0\t{p}\t{a0}\t{a1}\n" for c, s, p in zip(chroms, names, positions, strict=True))
    )
    Path(f"{prefix}.fam").write_text("".join(f"{i}\t{i}\t0\t0\t0\t-9\n" for i in iids))
