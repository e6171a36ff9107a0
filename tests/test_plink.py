import numpy as np
import pytest
from pyspark.sql import functions as F

from allelia.sources import plink


@pytest.fixture(scope="module")
def fileset(tmp_path_factory):
    rng = np.random.default_rng(5)
    dosage = rng.integers(0, 3, (50, 30)).astype(float)  # 50 isn't a multiple of 4
    dosage[rng.random(dosage.shape) < 0.1] = np.nan
    prefix = str(tmp_path_factory.mktemp("bed") / "a")
    plink.write_plink(prefix, dosage, [f"I{i}" for i in range(50)], ["1"] * 12 + ["X"] * 18, list(range(30)))
    return prefix, dosage


def test_round_trip_and_tables(spark, fileset):
    prefix, dosage = fileset
    rows = plink.read_bed(spark, prefix, variants_per_partition=7).orderBy("variant_index").collect()
    assert np.array_equal(plink.dosages([r["calls"] for r in rows], 50).T, dosage, equal_nan=True)
    bim, fam = plink.read_bim(spark, prefix).orderBy(
        "variant_index"
    ).collect(), plink.read_fam(spark, prefix).orderBy("sample_index").collect()
    assert [r["snp"] for r in bim] == [f"rs{i}" for i in range(30)] and [r["pos"] for r in bim] == list(range(30))
    assert [r["iid"] for r in fam] == [f"I{i}" for i in range(50)]


def test_subsets_and_pruning(spark, fileset):
    prefix, dosage = fileset
    some = [0, 3, 17, 49]
    rows = plink.read_bed(spark, prefix, samples=some).where(
        (F.col("variant_index") >= 11) & (F.col("variant_index") < 20)
    ).orderBy("variant_index").collect()
    assert np.array_equal(plink.dosages([r["calls"] for r in rows], 4).T, dosage[some, 11:20], equal_nan=True)
    only = plink.read_bed(spark, prefix).where("chrom = 'X'")
    assert [r["variant_index"] for r in only.orderBy("variant_index").collect()] == list(range(12, 30))
    assert np.array_equal(plink.unpack(plink.BedFile(prefix).packed(2, 5), 50, np.array(some)), dosage[some, 2:5].T, equal_nan=True)
    with pytest.raises(IndexError):
        plink.unpack(plink.BedFile(prefix).packed(0, 1), 50, np.array([50]))


def test_ranges_and_a_streamed_fileset(spark, fileset, tmp_path):
    prefix, dosage = fileset
    some = plink.read_bed(spark, prefix).where((F.col("variant_index") > 4) & (F.col("variant_index") <= 21) & F.col("chrom").isin("1", "X"))
    assert [r["variant_index"] for r in some.orderBy("variant_index").collect()] == list(range(5, 22))
    parts = plink.BedReader({"prefix": prefix, "variants_per_partition": "7"}).partitions()
    assert [(p.start, p.stop) for p in parts] == [(a, min(a + 7, 30)) for a in range(0, 30, 7)]
    lines = open(f"{prefix}.bim", "rb").read()
    assert all(lines[p.line :].split()[1] == f"rs{p.start}".encode() for p in parts)
    again = plink.write_fileset(plink.read_bed(spark, prefix, variants_per_partition=4), [f"I{i}" for i in range(50)], str(tmp_path / "w"))
    assert all(open(f"{again}{x}", "rb").read() == open(f"{prefix}{x}", "rb").read() for x in (".bed", ".bim", ".fam"))


def test_long_and_block_forms_agree(spark, fileset):
    prefix, dosage = fileset
    long = plink.to_long(plink.read_bed(spark, prefix), 50)
    back = plink.to_blocks(long, 50).orderBy("variant_index").collect()
    assert np.array_equal(plink.dosages([r["calls"] for r in back], 50).T, dosage, equal_nan=True)


def test_bad_headers(spark, fileset, tmp_path):
    for head, said in ((b"\x00\x1b\x01", "not a PLINK"), (b"\x6c\x1b\x00", "sample-major")):
        plink.write_plink(str(tmp_path / "b"), np.zeros((4, 2)), list("abcd"), ["1", "1"], [1, 2])
        data = (tmp_path / "b.bed").read_bytes()
        (tmp_path / "b.bed").write_bytes(head + data[3:])
        with pytest.raises(ValueError, match=said):
            plink.read_bed(spark, str(tmp_path / "b"))
