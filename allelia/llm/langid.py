"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A text is lower-cased and every run of characters that aren't letters becomes one space. Each language has character
n-gram counts of its share of a bounded training sample: raw counts at the highest order, counts of distinct left
neighbours below it, absolute discounts estimated from the counts of counts. The languages' n-grams are merged into one
sorted array of 64-bit hashes per order, with a row of log probabilities beside it; a text's cross-entropy is the mean
over all its characters, and the language with the lowest wins (ties: the smaller name).

The score is the winner's share of a softmax over the cross-entropies, whose temperature is fitted on texts that the
models weren't learned from; the same texts give each language a limit that at most REJECT of them pass (the conformal
quantile, and SLACK more), and a text whose best cross-entropy lies above it is rejected.

Bounds: per language, the SAMPLE labelled documents of the smallest hashes of their ids train the models and the CALIBRATE
next ones calibrate; all of each text is used. Languages are counted each in a task, merged in one, and cross-entropies
of the calibrating texts are taken by all executors; the driver holds the merged model as bytes. Every document is
predicted on its whole text, a long one piece by piece, with the last characters carried on.

Defined results: a null text or one without letters is `und` with score 0 and rejected; a null doc_id or null label isn't
learned from; repeated rows are predicted alike; without any labelled document every text is `und` and none with letters
is rejected, for nothing is known to reject it by; a language of fewer calibrating texts than 1 / REJECT takes their
largest value for the quantile, one of fewer than 5 rejects nothing; further columns are kept by `keep` and not read.
"""

from __future__ import annotations

import io
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, kept, materialize, mix, scratch, share, sliced, small, tidy

ORDER = 5
SAMPLE, CALIBRATE = 400, 1000
#: The share of a language's own texts that may be rejected, and what the limit lies above their quantile (in nats).
REJECT, SLACK = 0.001, 0.5
#: Characters of a text that are worked on at once.
CHARS = 1 << 19
#: The alphabet's assumed size, for characters that no language has seen.
ALPHABET = 1 << 16
UNDETERMINED = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(1 << 16)]))
    found = _letters[0][np.minimum(codes, 65535)]
    for c in np.unique(codes[codes > 65535]):
        found[codes == c] = chr(c).isalpha()
    return found


def normalised(text: str, before: bool = False) -> tuple[np.ndarray, bool]:
    """A text's (or piece's) code points: letters, and one space for what follows a letter; before: whether a letter precedes. And whether it ends in one."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(codes)
    after = np.concatenate([[before], letter[:-1]])[: len(codes)]
    return np.where(letter, codes, np.uint32(32))[letter | after].astype(np.uint64), bool(letter[-1]) if len(codes) else before


def blocks(texts: list[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of about CHARS characters: code points, which of them count, and of which text each is.

    A text comes after order - 1 spaces and ends in a space if its last character is a letter. What a block has of a text
    that began in the block before comes after that one's last order - 1 characters.
    """
    codes: list[np.ndarray] = []
    counted: list[np.ndarray] = []
    of: list[np.ndarray] = []
    size = 0

    def told() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate(codes), np.concatenate(counted), np.concatenate(of)

    for i, text in enumerate(texts):
        carry, before = np.full(order - 1, 32, np.uint64), False
        for at in range(0, len(text) + 1, CHARS):
            part = text[at : at + CHARS]
            found, before = normalised(part if at + CHARS <= len(text) else part + "\n", before)
            codes.append(np.concatenate([carry, found]))
            counted.append(np.arange(len(codes[-1])) >= order - 1)
            of.append(np.full(len(codes[-1]), i))
            carry, size = codes[-1][len(codes[-1]) - (order - 1) :], size + len(found)
            if size >= CHARS:
                yield told()
                codes, counted, of, size = [], [], [], 0
    if codes:
        yield told()


def grams(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k from 0 to order: hash of the k characters that end at each place (zero-padded at the front)."""
    out, power = [np.zeros(len(codes), np.uint64)], np.uint64(1)
    total = np.zeros(len(codes), np.uint64)
    for k in range(1, order + 1):
        total = total.copy()
        total[k - 1 :] += (codes[: len(codes) - k + 1] + np.uint64(7)) * power
        power = np.uint64(int(power) * int(_STEP) & (1 << 64) - 1)
        out.append(mix(total + np.uint64(k)))
    return out


def _summed(keys: np.ndarray, counts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their counts added up, and the first row of more of each."""
    found, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return found, np.bincount(which, weights=counts, minlength=len(found)).astype(np.int64), more[first]


def count(texts: list[str], order: int) -> dict[str, np.ndarray]:
    """One language's model: for each order k its n-grams, their probability, suffix and context, and the contexts' back-off mass."""
    found, counts, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 2 * order), np.uint64)
    for codes, counted, _ in blocks(texts, order):
        h = grams(codes, order)
        at = np.flatnonzero(counted)
        # of each n-gram of the highest order: the hashes of its suffixes of 0 to order - 1 characters, and those of the place before
        mine = np.stack([*(h[k][at] for k in range(order)), *(h[k][at - 1] for k in range(order))], 1) if len(at) else rows[:0]
        mine = _summed(h[order][at], np.ones(len(at)), mine)
        found, counts, rows = _summed(
            np.concatenate([found, mine[0]]), np.concatenate([counts, mine[1]]), np.concatenate([rows, mine[2]])
        )
    levels: list[tuple] = []
    for k in range(order, 0, -1):
        levels.append((k, found, counts, rows))
        if k > 1:  # below the highest order an n-gram counts once for each of its left neighbours
            found, counts, rows = _summed(rows[:, k - 1], np.ones(len(rows)), rows)
    out: dict[str, np.ndarray] = {}
    below: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, found, counts, rows in reversed(levels):
        one, two = (counts == 1).sum(), (counts == 2).sum()
        discount = float(np.clip(one / max(1, one + 2 * two), 0.1, 0.95))
        suffix, context = rows[:, k - 1], rows[:, order + k - 1]
        contexts, which, types = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(which, weights=counts)
        mass = discount * types / total
        lower = 1 / ALPHABET if k == 1 else below[k - 1][1][np.searchsorted(below[k - 1][0], suffix)]
        p = np.maximum(counts - discount, 0) / total[which] + mass[which] * lower
        below[k] = (found, p)
        out |= {f"gram{k}": found, f"p{k}": p, f"suffix{k}": suffix, f"of{k}": context, f"context{k}": contexts, f"mass{k}": mass}
    return out


def _at(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.searchsorted(sorted_keys, keys)
    place[place == len(sorted_keys)] = 0
    return place, sorted_keys[place] == keys if len(sorted_keys) else np.zeros(len(keys), bool)


@dataclass
class Model:
    """The merged models of all languages. grams and contexts: for each order, sorted hashes and a row per hash of each language's log probability or log back-off mass."""

    languages: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def merge(cls, parts: dict[str, dict[str, np.ndarray]], order: int) -> Model:
        names = sorted(parts)
        model = cls(names, order, [], [])
        for k in range(1, order + 1):
            known = np.unique(np.concatenate([parts[x][f"context{k}"] for x in names]))
            mass = np.ones((len(known), len(names)))
            for j, x in enumerate(names):
                mass[np.searchsorted(known, parts[x][f"context{k}"]), j] = parts[x][f"mass{k}"]
            found, first = np.unique(np.concatenate([parts[x][f"gram{k}"] for x in names]), return_index=True)
            suffix, of = (np.concatenate([parts[x][f"{c}{k}"] for x in names])[first] for c in ("suffix", "of"))
            lower = np.full((len(found), len(names)), -np.log(ALPHABET)) if k == 1 else model.grams[-1][1][
                np.searchsorted(model.grams[-1][0], suffix)
            ].astype(float)
            table = np.log(mass[np.searchsorted(known, of)]) + lower
            for j, x in enumerate(names):
                table[np.searchsorted(found, parts[x][f"gram{k}"]), j] = np.log(parts[x][f"p{k}"])
            model.grams.append((found, table.astype(np.float32)))
            model.contexts.append((known, np.log(mass).astype(np.float32)))
        return model

    def _log_p(self, h: list[np.ndarray], places: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.full((len(places), len(self.languages)), -np.log(ALPHABET), np.float32)
        keys, values = self.grams[k - 1]
        place, known = _at(keys, h[k][places])
        out = values[place]
        if not known.all():
            rest = places[~known]
            contexts, mass = self.contexts[k - 1]
            at, seen = _at(contexts, h[k - 1][rest - 1])
            out[~known] = np.where(seen[:, None], mass[at], np.float32(0)) + self._log_p(h, rest, k - 1)
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability of each text's characters in each language, and the number of letters-and-gaps counted."""
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for codes, counted, of in blocks(texts, self.order):
            places = np.flatnonzero(counted)
            if len(places):
                log_p = self._log_p(grams(codes, self.order), places, self.order)
                own, first, n = np.unique(of[places], return_index=True, return_counts=True)
                sums[own] += np.add.reduceat(log_p, first, axis=0, dtype=np.float64)
                counts[own] += n
        return -sums / np.maximum(counts, 1)[:, None], counts

    def to_bytes(self) -> bytes:
        parts = {
            f"{name}{k}_{j}": x for name, tables in (("g", self.grams), ("c", self.contexts)) for k, pair in enumerate(tables)
            for j, x in enumerate(pair)
        }
        np.savez_compressed(out := io.BytesIO(), languages=np.array(self.languages, "U"), **parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        f = np.load(io.BytesIO(data))
        order = sum(x.startswith("g") for x in f.files) // 2
        tables = [[(f[f"{name}{k}_0"], f[f"{name}{k}_1"]) for k in range(order)] for name in "gc"]
        return cls(f["languages"].tolist(), order, *tables)


def temperature_of(entropy: np.ndarray, own: np.ndarray) -> float:
    """The softmax's temperature by likelihood, of texts whose language is number own."""
    if not len(own):
        return 16.0

    def likelihood(t: float) -> float:
        z = -entropy * t
        top = z.max(1)
        return float((z[np.arange(len(own)), own] - top - np.log(np.exp(z - top[:, None]).sum(1))).sum())

    return max(np.geomspace(1, 256, 33).tolist(), key=likelihood)


def limit_of(own: np.ndarray) -> float:
    """The cross-entropy above which at most REJECT of a language's texts are expected, from those of its calibrating texts."""
    n = len(own)
    return float(np.sort(own)[min(n, int(np.ceil((n + 1) * (1 - REJECT)))) - 1]) + SLACK if n >= 5 else np.inf


@dataclass
class Identifier:
    """A merged model as bytes, the softmax's temperature and each language's limit; empty data: no language is known."""

    data: bytes
    temperature: float
    limits: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected, for each text."""
        if not self.data:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.array(
                [not _is_letter(np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)).any() for t in texts],
                bool
            )
        model = _loaded(self.data)
        entropy, counts = model.cross_entropy(texts)
        best = entropy.argmin(1)
        lowest = entropy[np.arange(len(best)), best]
        score = 1 / np.exp(-(entropy - lowest[:, None]) * self.temperature).sum(1)
        none = counts == 0
        rejected = none | (lowest > self.limits[best])
        return [
            UNDETERMINED if e else model.languages[b] for b, e in zip(best, none, strict=True)
        ], np.where(none, 0.0, score), rejected


def _loaded(data: bytes) -> Model:
    """This worker's model, until another operator's state is kept."""
    return kept(("language", data), lambda: Model.from_bytes(data))


def sample(docs: DataFrame, learn: Column, size: int, more: int) -> DataFrame:
    """lang, text, held of the size + more labelled documents per language of the smallest hashes of their ids; the last ones are held out.

    Ranks are taken per language and salt first, so that a language that most documents have isn't ranked in one task.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    keyed = labelled.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"), F.xxhash64("doc_id").alias("key")
    )
    least = lambda df, by, n: df.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*by).orderBy("key"))
    ).where(F.col("rank") <= n)
    ranked = least(
        least(keyed.select("lang", "key", F.pmod("key", F.lit(64)).alias("salt")), ["lang", "salt"], size + more), ["lang"],
        size + more
    )
    limit = ranked.groupBy(F.col("lang").alias("of")).agg(F.max("key").alias("limit"))
    near = keyed.join(
        small(materialize(limit, "limits")), (F.col("lang") == F.col("of")) & (F.col("key") <= F.col("limit"))
    ).drop("of", "limit")
    chosen = near.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy("key", F.length("text"), "text"))
    ).where(F.col("rank") <= size + more)
    # with few documents, every fifth is held out
    count = F.count("*").over(Window.partitionBy("lang"))
    return chosen.select(
        "lang", "text", F.when(count > 5 * size // 4, F.col("rank") > size).otherwise(F.col("rank") % 5 == 0).alias("held")
    )


def fit(docs: DataFrame, learn: Column | None = None, size: int = SAMPLE, more: int = CALIBRATE, order: int = ORDER) -> Identifier:
    """Models of every language that the learnable documents name. learn: a condition on doc_id; by default all are learned from."""
    spark = docs.sparkSession

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        texts = frame.sort_values("text", kind="stable")["text"].tolist()
        np.savez(out := io.BytesIO(), **count([t for t in texts if any(map(str.isalpha, t))] or ["a"], order))
        give_back()
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "model": [out.getvalue()]})

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        parts = {k: dict(np.load(io.BytesIO(x))) for k, x in zip(frame["lang"], frame["model"], strict=True)}
        return pd.DataFrame({"languages": [sorted(parts)], "model": [Model.merge(parts, order).to_bytes()]})

    with scratch(spark):
        chosen = materialize(sample(docs, F.lit(True) if learn is None else learn, size, more), "sample")
        one_each = chosen.where("NOT held").groupBy("lang").applyInPandas(one, "lang string, model binary")
        rows = one_each.groupBy(F.lit(0).alias("all")).applyInPandas(merged, "languages array<string>, model binary").collect()
        if not rows:
            return Identifier(b"", 1.0, np.zeros(0))
        names, data = rows[0]["languages"], bytes(rows[0]["model"])
        held = share(spark, data)

        @tidy
        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 1):
                entropy, counts = _loaded(held.value).cross_entropy(batch.column(1).to_pylist())
                some = pa.array(counts > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(entropy.tolist(), pa.list_(pa.float64()))], names=["lang", "entropy"]
                ).filter(some)

        bounded_batches(spark)
        told = chosen.where(F.col("held") & F.col("lang").isin(names)).select("lang", "text").mapInArrow(
            measure, "lang string, entropy array<double>"
        ).collect()
    entropy = np.array([r["entropy"] for r in told]).reshape(-1, len(names))
    own = np.array([names.index(r["lang"]) for r in told], int)
    return Identifier(data, temperature_of(entropy, own), np.array([limit_of(entropy[own == j, j]) for j in range(len(names))]))


def _scan(docs: DataFrame, model: Identifier, schema: str, make) -> DataFrame:
    shared = share(docs.sparkSession, model)
    place = docs.columns.index("text")

    @tidy
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, place):
            yield make(batch, *shared.value.predict([x or "" for x in batch.column(place).to_pylist()]))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(predict, schema)


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every document."""

    def make(batch: pa.RecordBatch, names: list[str], score: np.ndarray, rejected: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
            names=["doc_id", "lang_pred", "score", "rejected"]
        )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scan(narrow, model, "doc_id long, lang_pred string, score double, rejected boolean", make)


def keep(docs: DataFrame, model: Identifier) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns as they were."""
    return _scan(docs, model, docs.schema, lambda batch, names, score, rejected: batch.filter(pa.array(~rejected)))
