"""Packing of tokenised documents into sequences: first-fit decreasing with a tournament tree of bin capacities.

Each document is tokenised once, cut at multiples of the sequence length, and only the pieces' numbers go on. Pieces of a
whole sequence need no packing. The others are dealt into random groups of bounded size; each group is packed on its own
by first-fit decreasing: a tournament tree over the open bins holds the largest remaining capacity under each node, so
the leftmost bin that a piece fits is found in logarithmic time.

Defined results: a null text is empty and has the end token alone; rows that repeat, or share a doc_id, are packed each on
their own; a null doc_id is kept as null; an empty table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept, materialize, tidy

SEQUENCE, END_ID = 4096, 2
#: Pieces of one packing group on average; a group is one task's memory.
GROUP = 20_000
#: Entries of a worker's word cache, which is emptied when full: some 40 MB.
CACHE = 200_000

_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Texts for which normalising means lower-casing alone, and whose white space is ASCII.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\xffĀ-įĲ-ž]*")


#: The characters that byte-level vocabularies write bytes 0 to 255 as.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTED]
_BYTES = {b: 256 + k for k, b in enumerate(_OTHERS)}


class Words(dict):
    """Ids of lower-case words as little-endian bytes, encoded when first asked for; never more than CACHE, emptied when full."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def _encode(self, piece: str) -> bytes:
        if len(piece) > 40:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        else:  # a piece is in normal form and is not cut further, so the model alone tells its ids
            written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
            ids = [t.id for t in self.model.tokenize(written)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        found = [] if word.isalpha() else _PIECE.findall(word)
        ids = self._encode(word) if len(found) < 2 else b"".join([self[p] for p in found])
        if len(word) <= 40:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids


class WordTokens:
    """Ids of whole texts as little-endian bytes, each word and piece of a word encoded once and then remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self.tokenizer)

    def ids(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            found = self.tokenizer.encode(unicodedata.normalize("NFC", text), add_special_tokens=False).ids
            return np.array(found, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.lower().split()))


def tokens(path: str) -> WordTokens:
    """This worker's tokenizer for a file; it outlives tasks with its cache, until another operator's state is kept."""
    return kept(("tokens", path), lambda: WordTokens(path))


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece: documents cut at multiples of the sequence length."""

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = tokens(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = model.ids(text.as_py() or "") + end
                n = len(ids) // 4
                rows.extend(
                    (doc_id, at, min(sequence, n - at), zlib.crc32(ids[4 * at : 4 * (at + sequence)]), n)
                    for at in range(0, n, sequence)
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Pieces go longest first, each into the leftmost bin that still holds it."""
    n = len(lengths)
    size = 1 << max(0, (n - 1)).bit_length()
    tree = [capacity] * (2 * size)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, at = int(lengths[i]), 1
        while at < size:  # down to the leftmost leaf with room
            at *= 2
            if tree[at] < need:
                at += 1
        bins[i], offsets[i] = at - size, capacity - tree[at]
        tree[at] -= need
        while at > 1:  # replay the matches above it
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded (the sequence's length with padding)."""
    cut = materialize(pieces(docs, tokenizer, sequence, end_id), "pieces")
    parts = cut.where(F.col("length") < sequence)
    groups = max(1, -(-parts.count() // group))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(
            ["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True
        )
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), sequence)
        used = np.bincount(bins, weights=frame["length"])
        whole = used.astype(np.int64)
        padded = np.where(whole & (whole - 1), sequence, whole)
        return frame.assign(
            sequence_id=frame["group"].to_numpy() + groups * bins, offset=offsets, padded=padded[bins]
        ).drop(columns="group")

    salted = parts.withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded"]
    packed = salted.groupBy("group").applyInPandas(fill, ", ".join(f"{c} long" for c in columns))
    full = cut.where(F.col("length") == sequence).select(
        *columns[:5], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(sequence).cast("long").alias("padded")
    )
    return packed.select(columns).unionByName(full)
