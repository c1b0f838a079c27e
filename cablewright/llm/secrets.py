"""Secret scans: fixed patterns, and a battery of randomness tests on long runs.

A candidate is a run of at least `LEAST` characters of the usual encodings; a '=' that isn't padding
at a run's end parts two candidates, as in name=value. The smallest alphabet that holds its characters
is inferred (decimal, hexadecimal in either case, base 32, lower-case base 36, base 62, base 64). The
tests take the run for a sequence drawn evenly from that alphabet, its characters in the order of how
common they are in ordinary text, the corpus's shorter runs without digits:

* chi-squared uniformity over the alphabet's characters, and over its four quarters;
* runs: how often neighbours lie on different sides of the alphabet's middle;
* serial correlation of neighbours' places, and how many pairs of neighbours repeat.

Fisher's method combines their p-values to one, the run's evenness. What an ordinary run of a length
would reach is known from strings of that length that a chain of characters yields, whose transitions
are counted over all ordinary text, words joined. For each class of length, a step-up rule after
Benjamini and Hochberg rejects "ordinary" for the most even candidates, so that the expected share of
ordinary runs among all that are found stays below the level. A run that it rejects, and whose evenness
itself isn't rejected, is a span of kind `random`.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._shared import batched, saved

#: Fixed patterns of the contract, in their order.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_ANY = re.compile(r"(?ai:passw|secret|token|api_?key)")
LEAST = 20
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?")
#: Share of ordinary runs among those found, the lengths at which classes begin, and the share of even runs that may be lost.
LEVEL, CLASSES, UNEVEN = 0.05, (20, 24, 32, 40, 64, 128), 1e-4
#: Eighths of a natural-log unit in which evenness is counted, and how many.
STEP, BINS = 8, 512
#: Ordinary strings drawn for each class of length, and the share of the most even ones that the tail is fitted to.
DRAWS, TAIL = 4000, 0.02
#: Transitions of the prior chain, and letters from the commonest in English to the rarest: a fixed value.
PRIOR, _COMMON = 100, "etaoinshrdlcumwfgypbvkjxqz"
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALL = _DIGITS + _UPPER + _LOWER + "+/_-"
_ALPHABETS = [("decimal", _DIGITS), ("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("base32", "234567" + _UPPER), ("base36", _DIGITS + _LOWER), ("base62", _DIGITS + _UPPER + _LOWER), ("base64", ALL)]
_SETS = [(name, set(a)) for name, a in _ALPHABETS]
_AT = np.full(256, len(ALL), np.int64)
_AT[[ord(c) for c in ALL]] = np.arange(len(ALL))


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) for a chi-squared variable, by the series of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term = total = 1.0
        for k in range(1, df // 2):
            term *= x / 2 / k
            total += term
        return min(1.0, math.exp(-x / 2) * total) if x < 1400 else 0.0
    total, term = 0.0, math.sqrt(2 * x / math.pi) * math.exp(-x / 2) if x < 1400 else 0.0
    for k in range(1, df, 2):
        total += term
        term *= x / (k + 2)
    return min(1.0, math.erfc(math.sqrt(x / 2)) + total)


def _normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def encoding(run: str) -> str | None:
    """The smallest of the alphabets that holds the run, without its padding."""
    have = set(run.rstrip("="))
    return next((name for name, s in _SETS if have <= s), None)


class Battery:
    """order: the characters of `ALL`, the commonest in ordinary text first."""

    def __init__(self, order: str = ALL):
        self.tables = {}
        for name, own in _SETS:
            a = [c for c in order if c in own]
            place = np.zeros(128, np.int64)
            place[[ord(c) for c in a]] = np.arange(len(a))
            self.tables[name] = (place, len(a), np.bincount(np.arange(len(a)) * 4 // len(a)) / len(a))

    def evenness(self, run: str) -> float:
        """The combined p-value of the tests; 0 for a run of no encoding or of fewer than `LEAST` characters."""
        body = run.rstrip("=")
        name = encoding(run)
        if name is None or len(body) < LEAST:
            return 0.0
        place, size, share = self.tables[name]
        x = place[np.frombuffer(body.encode(), np.uint8)]
        n = len(x)
        got = np.bincount(x, minlength=size)
        stat = size / n * float((got * got).sum()) - n
        # A chi-squared variable of the statistic's mean and variance.
        df = max(1, round((size - 1) * n / (n - 1)))
        cells = chi2_tail(stat * df / (size - 1), df)
        quarter = np.bincount(x * 4 // size, minlength=4)
        quarters = chi2_tail(float(((quarter - n * share) ** 2 / (n * share)).sum()), 3)
        high = x * 2 >= size
        changes = int((high[1:] != high[:-1]).sum())
        odds = 2 * high_share(size) * (1 - high_share(size))
        runs = _normal(max(0.0, abs(changes - odds * (n - 1)) - 0.5) / math.sqrt(odds * (1 - odds) * (n - 1)))
        y = x - (size - 1) / 2
        serial = _normal(float((y[1:] * y[:-1]).sum()) / ((size * size - 1) / 12) / math.sqrt(n - 1))
        expect = (n - 1) * (n - 2) / 2 / size**2
        excess = n - 1 - len(np.unique(x[1:] * size + x[:-1])) - expect
        pairs = _normal(max(0.0, excess) / math.sqrt(expect + 0.25))
        tests = (cells, quarters, runs, serial, pairs)
        if min(tests) <= 0:
            return 0.0
        return chi2_tail(-2 * sum(map(math.log, tests)), 2 * len(tests))


def high_share(size: int) -> float:
    """The share of an alphabet's places that lie in its upper half."""
    return (size // 2) / size


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    if _ANY.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _bin(p: float) -> int:
    return BINS - 1 if p <= 0 else min(BINS - 1, int(-math.log(p) * STEP))


_SCANNED = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", pa.list_(pa.struct([("a", pa.int64()), ("k", pa.int32()), ("b", pa.int64())]))), ("runs", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("bin", pa.int32()), ("size", pa.int32())])))])
_SCANNED_DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<a: long, k: int, b: long>>, runs array<struct<a: long, b: long, bin: int, size: int>>"


def _chain(batches):
    """Transitions between neighbouring characters of ordinary text: runs without digits of fewer than `LEAST` characters, joined."""
    size = len(ALL)
    total = np.zeros(size * size, np.int64)
    for batch in batches:
        data, at = T.raw(batch.column("text"))
        for a, b in T.slices(at):
            total += transitions(data[at[a] : at[b]])
    code = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])


def transitions(data: np.ndarray) -> np.ndarray:
    size = len(ALL)
    code = _AT[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], code < size, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    digits = np.concatenate([[0], np.cumsum(code < len(_DIGITS))])
    out = (end - begin >= LEAST) | (digits[end] > digits[begin])
    change = np.zeros(len(code) + 1, np.int8)
    change[begin[out]], change[end[out]] = 1, -1
    code[np.cumsum(change[:-1]) > 0] = size
    code = code[code < size]
    return np.bincount(code[:-1] * size + code[1:], minlength=size * size) if len(code) > 1 else np.zeros(size * size, np.int64)


class Ordinary:
    """What is known of ordinary text: the characters' order, and how even its strings get.

    counts: transitions from character to character. To them `PRIOR` are added, from vowels to
    consonants and back, so that there is a chain without any text.
    """

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(len(ALL), len(ALL)).astype(float)
        often = 1 / np.arange(1, 27)
        vowel = np.array([x in "aeiou" for x in _COMMON])
        part = np.where(vowel[:, None] != vowel, often[:, None] * often, 0.0)
        own = [ALL.index(x) for x in _COMMON]
        c[np.ix_(own, own)] += PRIOR * part / part.sum()
        often = c.sum(axis=1)
        self.order = "".join(sorted(ALL, key=lambda x: (-often[ALL.index(x)], x)))
        self.start = np.cumsum(often) / often.sum()
        self.step = np.cumsum(np.where(often[:, None] > 0, c, often), axis=1)
        self.step /= self.step[:, -1:]

    def strings(self, length: int, number: int) -> list[str]:
        rng = np.random.Generator(np.random.PCG64(length))
        last = len(ALL) - 1
        out = [np.minimum(np.searchsorted(self.start, rng.random(number), "right"), last)]
        for _ in range(length - 1):
            out.append(np.minimum((self.step[out[-1]] <= rng.random(number)[:, None]).sum(axis=1), last))
        return ["".join(ALL[k] for k in row) for row in np.array(out).T]

    def tails(self) -> np.ndarray:
        """For each class of length and bin: the share of ordinary strings of the class's least length that are as even as the bin or more.

        Beyond the most even `TAIL` of what is drawn the share falls off exponentially.
        """
        battery = Battery(self.order)
        low = -(np.arange(BINS) + 1) / STEP  # log of the least evenness in a bin
        out = np.ones((len(CLASSES), BINS))
        for k, length in enumerate(CLASSES):
            s = np.sort([math.log(max(battery.evenness(x), 1e-300)) for x in self.strings(length, DRAWS)])[::-1]
            few = max(1, int(TAIL * DRAWS))
            mean = max(0.25, float((s[:few] - s[few]).mean()))
            drawn = (np.searchsorted(-s, -low, "right") + 1) / (DRAWS + 1)
            out[k] = np.where(low >= s[few], few / DRAWS * np.exp(-(low - s[few]) / mean), np.maximum(drawn, few / DRAWS))
        out[:, -1] = 1.0
        return out


def _scan(order: str):
    battery = Battery(order)

    def run(batches):
        yield from _scanned(batches, battery)

    return run


def _scanned(batches, battery: Battery):
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for k in range(0, len(ids), 512):
            rows = []
            for doc, text in zip(ids[k : k + 512].to_pylist(), texts[k : k + 512].to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                runs = []
                for m in _RUN.finditer(text):
                    p = battery.evenness(m[0])
                    size = sum(m.end() - m.start() >= c for c in CLASSES) - 1
                    runs.append({"a": m.start(), "b": m.end(), "bin": _bin(p), "size": size})
                n = [sum(x[1] == c for x in base) for c in range(3)]
                rows.append({"doc_id": doc, "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(_join(base).encode()).hexdigest(), "base": [{"a": a, "k": c, "b": b} for a, c, b in base], "runs": runs})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCANNED)


def thresholds(counts: dict[tuple[int, int], int], tails: np.ndarray, level: float = LEVEL) -> list[int]:
    """For each class of length, the first bin that isn't found any more, by the step-up rule.

    counts: (class, bin) -> candidates; tails: the share of ordinary strings as even as a bin. Bins
    of an evenness below `UNEVEN` are never found.
    """
    out = []
    for k in range(len(CLASSES)):
        n = np.array([counts.get((k, b), 0) for b in range(BINS)], float)
        so_far, total = np.cumsum(n), n.sum()
        ok = (so_far > 0) & (tails[k] * total <= level * so_far)
        ok[int(-math.log(UNEVEN) * STEP) :] = False
        out.append(int(np.flatnonzero(ok)[-1]) + 1 if ok.any() else 0)
    return out


def find_secrets(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """Secrets of whole texts: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row of docs.

    spans lists kind:start:end (code points, end exclusive) by start, then kind. A random span that
    lies within a fixed pattern's span is not listed again. Null and empty texts have none; repeated
    rows count each time, towards the chain and the step-up rule too. An empty table gives an empty
    result. Other columns are ignored.
    """

    docs = batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    # len(ALL) ** 2 rows at most.
    counts = np.zeros(len(ALL) ** 2, np.int64)
    for code, n in docs.select("text").mapInArrow(T.tidied(_chain), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[code] = n
    ordinary = Ordinary(counts)
    found = saved(docs.mapInArrow(T.tidied(_scan(ordinary.order)), _SCANNED_DDL), "scanned")
    cells = found.select(F.explode("runs").alias("r")).groupBy("r.size", "r.bin").agg(F.count("*").alias("n"))
    limits = thresholds({(s, b): n for s, b, n in cells.collect()}, ordinary.tails(), level)  # len(CLASSES) * BINS cells at most
    limit = F.expr("array(" + ",".join(map(str, limits)) + ")")
    kept = F.filter("runs", lambda r: (r["bin"] < F.get(limit, r["size"])) & ~F.exists("base", lambda s: (s["a"] <= r["a"]) & (s["b"] >= r["b"])))
    random = F.transform(kept, lambda r: F.struct(r["a"].alias("a"), F.lit(3).alias("k"), r["b"].alias("b")))
    every = F.array_sort(F.concat("base", random))
    kinds = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["a"], s["b"])), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.size(random).cast("long").alias("n_random"))
