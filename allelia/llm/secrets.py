"""Secret scans: three fixed patterns, and a linear-chain conditional random field that adds what they miss.

A chunk is a run of characters without white space. Its tokens are runs of ASCII letters, digits and `+/_.-`, runs of
characters beyond ASCII, and single other characters. Each token is secret-begin (B), inside (I) or outside (O). B is allowed only on a token of MIN_SECRET or more
ASCII characters with a digit, and I only after B or I, so every token of a chunk without such a token is O, and chunks
are decoded each on its own without changing the best sequence of the whole text: between chunks the state is O.
Emissions add up weights of the token's shape, the neighbouring words and marks, and the file; Viterbi finds the best
sequence. Weights are fitted by conditional likelihood on all chunks of a bounded sample of documents (SAMPLE documents by
a hash of their id and text, labelled by the fixed patterns) and on generated keys, numbers, addresses and dates. Executors
make the chunks' features; equal ones are counted, so the driver sees each once. In fitting, a long chunk is cut where
its labels are outside, and the parts are taken as given these labels.

Defined results: a null text is empty and has no spans; a null doc_id is kept; repeated rows are scanned alike; an empty
table gives no rows (the model is then fitted on generated chunks alone); further columns are kept by `redact`.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, share, sliced

SAMPLE = 400
MIN_SECRET = 8
MASK = "[SECRET]"
KINDS = ("assign", "access", "hex", "crf")

# The base patterns.
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_TOKEN = re.compile(r"[A-Za-z0-9+/_.\-]+|[\u0080-\U0010ffff]+|\S")
_KEYWORD = re.compile(r"(?ai:pass|secret|token|key|auth|bearer|credential|private)")
_WORD = re.compile(r"\S+")
_DIGIT, _LOWER, _HEXLIKE = re.compile(r"\d"), re.compile(r"[^\W\dA-Z_]"), re.compile(r"[0-9a-f]*[0-9][0-9a-f]*")
_LONG = re.compile(r"[A-Za-z0-9+/_.\-]{%d}" % MIN_SECRET)
_GAP = re.compile(r"\s")
#: Characters that are looked through at once.
CHARS = 1 << 20
#: Tokens from which on a chunk is cut in fitting, at the next token that is labelled outside.
CUT = 24
_LENGTHS = np.array([3, 6, 8, 12, 16, 20, 24, 32, 40, 64])
#: Values of each feature: length and digits; case and changes; hex and length; mark before; keyword's distance; joined before; file.
SIZES = (11 * 4, 4 * 5, 2 * 11, 6, 5, 2, 3, 6)
B, I, O = 0, 1, 2  # noqa: E741
_NO = -1e9


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) of every match of the fixed patterns, in order of start and kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _covered(a: int, b: int, base: list[tuple[int, int, str, int]]) -> bool:
    """Whether the base spans, in order of start, hold all of a to b."""
    for x, y, _, _ in base:
        if x <= a < y:
            a = y
    return a >= b


def _mark(c: str) -> int:
    return {"": 0, "=": 1, ":": 2, '"': 3, "'": 3, "@": 4}.get(c, 5)


def _words_before(text: str, start: int, n: int = 3) -> list[str]:
    """The last n words before a place."""
    reach = 64
    while True:
        low = max(0, start - reach)
        found = _WORD.findall(text[low:start])
        if low == 0 or len(found) > n:  # more than n: the first, which may be cut, isn't asked for
            return found[-n:]
        reach *= 4


def _changes(t: str) -> int:
    """How often a token's characters change between digit, upper case, other letters and marks; 10 for more."""
    changes, last = 0, ""
    for c in t:
        kind = "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "p"
        if kind != last:
            changes += bool(last)
            if changes == 10:
                break
            last = kind
    return changes


def features(text: str, start: int, end: int, file: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Of a chunk: its tokens' spans, feature values (tokens x SIZES) and whether each may begin a secret."""
    spans = [m.span() for m in _TOKEN.finditer(text, start, end)]
    before = _words_before(text, start)
    rows, may = [], []
    far = next((d for d, w in enumerate(reversed(before), 1) if _KEYWORD.search(w)), 4)
    words = 0 if far == 4 else far + 1
    keyed = [bool(_KEYWORD.search(text, x, y)) for x, y in spans]
    for i, (a, b) in enumerate(spans):
        t = text[a:b]
        digits = len(_DIGIT.findall(t))
        size = int(np.searchsorted(_LENGTHS, len(t), side="right"))
        case = 2 * (not t.islower() and any(map(str.isupper, t))) + (_LOWER.search(t) is not None)
        near = 1 if any(keyed[max(0, i - 3) : i]) else words
        previous = text[a - 1] if a > start else (before[-1][-1] if before else "")
        rows.append(
            (
                size * 4 + min(3, (digits + 2) // 3), case * 5 + min(4, (_changes(t) + 2) // 3),
                size + 11 * bool(_HEXLIKE.fullmatch(t)), _mark(previous), near, int(a > start), file, _mark(text[b : b + 1].strip())
            )
        )
        may.append(len(t) >= MIN_SECRET and digits > 0 and t.isascii())
    return spans, np.array(rows, np.int64).reshape(-1, len(SIZES)), np.array(may, bool)


def chunks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the chunks that hold a digit and MIN_SECRET characters or more."""
    at = 0
    while at < len(text):
        cut = _GAP.search(text, at + CHARS) if len(text) - at > CHARS else None
        to = cut.start() if cut else len(text)
        yield from ((a + at, b + at) for a, b in _chunks(text[at:to]))
        at = to if cut else len(text)


def _chunks(text: str) -> list[tuple[int, int]]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    digits = np.flatnonzero((codes - np.uint32(48)) < 10)
    if not len(digits):
        return []
    gaps = np.flatnonzero(_is_space(codes))
    right = np.unique(np.searchsorted(gaps, digits))
    starts = np.where(right > 0, gaps[np.maximum(right - 1, 0)] + 1, 0) if len(gaps) else np.zeros(1, np.int64)
    ends = np.append(gaps, len(codes))[right]
    long = ends - starts >= MIN_SECRET
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def _is_space(codes: np.ndarray) -> np.ndarray:
    found = _SPACES[np.minimum(codes, 0x3001)]
    return found


_SPACES = np.array([chr(c).isspace() for c in range(0x3002)])


def _file(text: str) -> int:
    """The file's feature: whether it names keys at all, and whether it looks like code or settings."""
    return int(_KEYWORD.search(text) is not None) + int(text.count("=") + text.count("{") > len(text) // 100 + 1)


class Field:
    """The chain's weights: one (values x 3) table per feature, and 4 x 3 transitions, of which row 3 is the start."""

    def __init__(self, tables: list[np.ndarray], moves: np.ndarray):
        self.tables, self.moves = tables, moves

    def emissions(self, rows: np.ndarray, may: np.ndarray) -> np.ndarray:
        out = sum((t[rows[:, i]] for i, t in enumerate(self.tables)), np.zeros((len(rows), 3)))
        out[~may, B] = _NO
        return out

    def decode(self, rows: np.ndarray, may: np.ndarray) -> list[int]:
        """Viterbi: the best states; ties go to the smaller state."""
        emit, moves = self.emissions(rows, may).tolist(), self.moves.tolist()
        score, back = [moves[3][s] + emit[0][s] for s in range(3)], []
        for e in emit[1:]:
            best = [max(range(3), key=lambda p, s=s: score[p] + moves[p][s]) for s in range(3)]
            score = [score[p] + moves[p][s] + e[s] for s, p in enumerate(best)]
            back.append(best)
        states = [max(range(3), key=score.__getitem__)]
        for best in reversed(back):
            states.append(best[states[-1]])
        return states[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Spans that the field tags in the whole text, without trailing full stops."""
        found, file = [], None
        for a, b in chunks(text):
            if not _LONG.search(text, a, b):
                continue
            file = _file(text) if file is None else file
            spans, rows, may = features(text, a, b, file)
            if not may.any():
                continue
            open_at = None
            for (x, y), s in zip([*spans, (b, b)], [*self.decode(rows, may), O], strict=True):
                if open_at is not None and s != I:
                    end = open_at[1]
                    while end > open_at[0] and text[end - 1] in ".,":
                        end -= 1
                    found.append((open_at[0], end))
                    open_at = None
                if s == B:
                    open_at = (x, y)
                elif s == I and open_at:
                    open_at = (open_at[0], y)
        return found

    def scan(self, text: str) -> list[tuple[int, int, str, int]]:
        """The base spans and the field's spans that base spans don't cover wholly, by start and kind."""
        base = base_spans(text)
        extra = [(a, b, "crf", a) for a, b in self.spans(text) if not _covered(a, b, base)]
        return sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2]))) if extra else base


def generated(seed: int = 11, n: int = 1500) -> list[tuple[str, list[tuple[int, int]]]]:
    """Sentences with one generated secret, or with a number, address or date that is none, and the secrets' spans."""
    rnd = random.Random(seed)
    pick = lambda chars, k: "".join(rnd.choices(chars, k=k))
    alnum, digits = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789"
    word = lambda: pick("abcdefghijklmnopqrstuvwxyz", rnd.randint(2, 11))
    secret = [
        lambda: pick("0123456789abcdef", rnd.choice([16, 20, 32, 40, 64])), lambda: pick(alnum + "+/", rnd.randint(20, 60)),
        lambda: rnd.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + pick(alnum, rnd.randint(20, 40)),
        lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
        lambda: ".".join(["eyJ" + pick(alnum, 20), pick(alnum, 40), pick(alnum + "_-", 43)])
    ]
    plain = [
        lambda: ".".join(str(rnd.randint(1, 255)) for _ in range(4)), lambda: pick(digits, rnd.randint(8, 19)),
        lambda: f"{rnd.randint(1900, 2099)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}",
        lambda: f"+{pick(digits, 2)}-{pick(digits, 3)}-{pick(digits, 7)}", lambda: f"{word()}{pick(digits, 2)}@{word()}.com",
        lambda: f"http://{word()}.{word()}/{word()}/{pick(digits, 4)}", lambda: f"{word()}_{word()}_{pick(digits, 2)}",
        lambda: f"v{pick(digits, 1)}.{pick(digits, 2)}.{pick(digits, 3)}", lambda: word() + pick(digits, 1) + word()
    ]
    out = []
    for _ in range(n):
        left = " ".join(word() for _ in range(rnd.randint(1, 6))) + " "
        hidden = rnd.random() < 0.5
        body = rnd.choice(secret if hidden else plain)()
        if hidden and rnd.random() < 0.7:
            left += rnd.choice(
                ["password", "token", "secret", "api_key", "auth_token", "access_key", "Authorization", "private_key"]
            ) + rnd.choice(["=", ": ", " = ", ' = "', ":", " "])
        elif not hidden and rnd.random() < 0.5:
            left += word() + rnd.choice(["=", ": ", " = ", " "])
        close = '"' if left.endswith('"') else ""
        text = left + body + close + rnd.choice([" ", ". ", ", "]) + word()
        out.append((text, [(len(left), len(left) + len(body))] if hidden else []))
    return out


#: A training sequence: feature rows, which tokens may begin, labels and the state before (3: none), as bytes of int8.
Sequence = tuple[bytes, bytes, bytes, int]


def sequences(text: str, secrets: list[tuple[int, int]]) -> Iterator[Sequence]:
    """The training sequences of a text whose secrets are known."""
    file = _file(text)
    for a, b in chunks(text):
        tokens, rows, may = features(text, a, b, file)
        if not may.any():
            continue
        states, last, k = [], None, 0
        for (x, y), ok in zip(tokens, may, strict=True):
            while k < len(secrets) and secrets[k][1] <= x:
                k += 1
            hit = secrets[k] if k < len(secrets) and secrets[k][0] < y else None
            states.append(O if hit is None else I if hit == last else B if ok else O)
            last = hit if states[-1] != O else None
        start, before = 0, 3
        for end in range(1, len(states) + 1):
            if end == len(states) or (end - start >= CUT and states[end - 1] == O):
                if may[start:end].any():
                    yield rows[start:end].astype(np.int8).tobytes(), may[start:end].tobytes(), np.array(
                        states[start:end], np.int8
                    ).tobytes(), before
                start, before = end, O


def _secrets_of(text: str) -> list[tuple[int, int]]:
    """The base spans' secrets, ascending and apart."""
    out: list[tuple[int, int]] = []
    for v, e in sorted((v, e) for _, e, _, v in base_spans(text)):
        if not out or v >= out[-1][1]:
            out.append((v, e))
    return out


def fit(samples: list[str], steps: int = 150) -> Field:
    """A field fitted on these texts, labelled by the fixed patterns, and on generated ones."""
    found: dict[Sequence, int] = {}
    for t in samples:
        for x in sequences(t, _secrets_of(t)):
            found[x] = found.get(x, 0) + 1
    return _fit(found, steps)


def _fit(found: dict[Sequence, int], steps: int = 150) -> Field:
    """Weights by gradient ascent on the conditional likelihood of these sequences, so many of each, and the generated ones."""
    found = dict(found)
    for text, spans in generated():
        for x in sequences(text, spans):
            found[x] = found.get(x, 0) + 1
    groups: dict[int, list[Sequence]] = {}
    for x in sorted(found):
        groups.setdefault(len(x[1]), []).append(x)
    total = sum(found.values())
    sets = []
    for t, mine in sorted(groups.items()):  # sequences of equal length are worked on together
        rows = np.frombuffer(b"".join(x[0] for x in mine), np.int8).reshape(len(mine), t, len(SIZES)).astype(np.int64)
        may = np.frombuffer(b"".join(x[1] for x in mine), bool).reshape(len(mine), t)
        gold = np.frombuffer(b"".join(x[2] for x in mine), np.int8).reshape(len(mine), t).astype(np.int64)
        sets.append((rows, may, gold, np.array([x[3] for x in mine]), np.array([found[x] for x in mine], float)))
    tables, moves = [np.zeros((k, 3)) for k in SIZES], np.zeros((4, 3))
    moves[[O, 3], I] = _NO
    weights = [*tables, moves]
    slopes = [np.zeros_like(w) for w in weights]
    for _ in range(steps):
        grads = [np.zeros_like(w) for w in weights]
        for data in sets:
            _slope(data, tables, moves, grads)
        for w, g, s in zip(weights, grads, slopes, strict=True):
            g = g / total - 2e-5 * np.where(w <= _NO, 0, w)
            s += g * g
            w += np.where(w <= _NO, 0, 0.5 * g / np.sqrt(s + 1e-9))
    return Field(tables, moves)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return top.squeeze(axis) + np.log(np.exp(x - top).sum(axis))


def _slope(data: tuple, tables: list[np.ndarray], moves: np.ndarray, grads: list[np.ndarray]) -> None:
    """Adds the gradient of the conditional log likelihood of sequences of one length, by forward and backward sums."""
    rows, may, gold, before, weight = data
    n, t = gold.shape
    emit = sum(w[rows[..., i]] for i, w in enumerate(tables))
    emit[~may, B] = _NO
    alpha, beta = np.zeros((n, t, 3)), np.zeros((n, t, 3))
    alpha[:, 0] = moves[before] + emit[:, 0]
    for j in range(1, t):
        alpha[:, j] = _lse(alpha[:, j - 1, :, None] + moves[None, :3], 1) + emit[:, j]
    for j in range(t - 2, -1, -1):
        beta[:, j] = _lse(moves[None, :3] + (emit[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
    z = _lse(alpha[:, -1], 1)
    margin = np.exp(np.minimum(alpha + beta - z[:, None, None], 0))
    change = (np.eye(3)[gold] - margin) * weight[:, None, None]
    for i, g in enumerate(grads[:-1]):
        np.add.at(g, rows[..., i].ravel(), change.reshape(-1, 3))
    np.add.at(grads[-1], before, change[:, 0])
    for j in range(1, t):
        both = np.exp(
            np.minimum(alpha[:, j - 1, :, None] + moves[None, :3] + (emit[:, j] + beta[:, j])[:, None, :] - z[:, None, None], 0)
        )
        grads[-1][:3] -= (both * weight[:, None, None]).sum(0)
        np.add.at(grads[-1], (gold[:, j - 1], gold[:, j]), weight)


def learn(docs: DataFrame, size: int = SAMPLE) -> Field:
    """A field fitted on the `size` documents of the smallest hashes of id and text."""
    spark = docs.sparkSession
    keyed = docs.where(F.col("text").isNotNull()).select(
        F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text")
    )
    keys = [r["key"] for r in keyed.select("key").orderBy("key").limit(size).collect()]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0):
            rows = [x for t in batch.column(0).to_pylist() for x in sequences(t, _secrets_of(t))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, k) for c,
                    k in zip(zip(*rows, strict=True) if rows else [[]] * 4, [pa.binary()] * 3 + [pa.int32()], strict=True)
                ],
                names=["rows", "may", "states", "before"]
            )

    bounded_batches(spark)
    made = keyed.where(F.col("key") <= (keys[-1] if keys else 0)).select("text").mapInArrow(
        make, "rows binary, may binary, states binary, before int"
    )
    told = made.groupBy("rows", "may", "states", "before").count().collect() if keys else []
    return _fit({(bytes(r["rows"]), bytes(r["may"]), bytes(r["states"]), r["before"]): r["count"] for r in told})


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document's whole text."""
    shared = share(docs.sparkSession, field)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    types = [pa.int64()] * 4 + [pa.string()] * 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                spans = shared.value.scan(text.as_py() or "")
                told = [(k, f"{k}:{a}:{b}") for a, b, k, _ in spans]
                base = [x for k, x in told if k != "crf"]
                kinds = [k for k, _ in told]
                rows.append(
                    (
                        doc_id, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(",".join(base).encode()).hexdigest(),
                        ",".join(x for _, x in told)
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def masked(text: str, field: Field) -> str:
    """The text with MASK in the place of every secret; an assignment keeps its name. Overlapping secrets become one."""
    out, at, end = [], 0, -1
    for a, b in sorted((v, e) for _, e, _, v in field.scan(text)):
        if a >= end:
            out += [text[at:a], MASK]
        at = end = max(end, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """Every document with its secrets masked and n_chars, if there, counted anew; other columns as they were."""
    shared = share(docs.sparkSession, field)
    place = docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, place):
            texts = pa.array(
                [None if x is None else masked(x, shared.value) for x in batch.column(place).to_pylist()],
                batch.schema.field(place).type
            )
            yield pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    bounded_batches(docs.sparkSession)
    out = docs.mapInArrow(mask, docs.schema)
    return out.withColumn(
        "n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    ) if "n_chars" in docs.columns else out
