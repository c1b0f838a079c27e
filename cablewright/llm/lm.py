"""Language-model scores by deleted interpolation.

The probability of a token after its predecessors g, h is

    m(a) * c(g, h, w) / c(g, h)  +  (1 - m(a)) * P(w | h)
    P(w | h) = l2(b) * c(h, w) / c(h)  +  l1(b) * c(w) / N  +  l0(b) / (V + 1)

with maximum-likelihood estimates from the training documents and weights l(b), m(a) for
the buckets b and a of the two contexts' frequencies, floor(log2(c + 1)) up to `BUCKETS` - 1.
A document's first token has its end as h, and as the pair (g, h). With `order` 2 the
score is P(w | h). The weights are learned by expectation-maximisation on the tokens of a
deleted part of the training documents, under the counts of the rest: first l, then m with
l fixed. The final model counts all of them.

Counts follow the corpus and are never gathered in one place. Slices of documents send
their distinct n-grams, as hashes, to tasks by hash range; those add up the counts and
answer each slice with the totals of its own n-grams. A range holds about `RANGE_KEYS` keys, so
their number follows the corpus; a slice's volume follows its root, up to `SLICE_MOST`. A slice
sends a message to each range that it has n-grams in, so there are never more messages than
n-grams: up to some hundred GB a message holds thousands of them, at 100 TB a few, and
messages then cost as much as rows would. A frequent word or a repeated passage is one entry of
each slice. A word's hash has 64 bits; of those of pairs and triples, 48 bits beyond the bits
that name the range are kept, so more of them as the corpus grows.

For EM the deleted part's tokens are counted by (bucket, eighth-octave of both estimates),
a grid of a fixed size for either step, so the driver holds at most the grid.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._shared import batched, saved

BUCKETS = 16
#: Levels of an estimate in the EM grid: eighths of an octave, and 0 for an estimate of 0.
LEVELS = 512
#: Distinct n-grams that a range's task should hold.
RANGE_KEYS = 3_000_000
#: A slice of documents: this many bytes times the root of the corpus's bytes, within limits.
SLICE_ROOT, SLICE_LEAST, SLICE_MOST = 128, 1 << 18, 64 << 20
#: Bytes of messages that a task yields at once.
SENT_BYTES = 4 << 20
TRAIN, DELETED, HELD_OUT = 0, 1, 2
_END = np.uint64(0x5851F42D4C957F2D)
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def _slices(batches, most: int, only: int | None = None):
    """(number of the slice, role, doc_id, text) with one role's rows in each slice, in a fixed order."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: dict[int, list] = {r: [] for r in (TRAIN, DELETED, HELD_OUT)}
    volume = dict.fromkeys(held, 0)

    def taken(r: int):
        ids, texts = zip(*held[r], strict=True)
        held[r], volume[r] = [], 0
        return pa.concat_arrays(ids), pa.concat_arrays(texts)

    for batch in batches:
        role = batch.column("role").to_numpy()
        for r in held:
            rows = np.flatnonzero(role == r)
            if not len(rows):
                continue
            part = batch.take(pa.array(rows))
            _, at = T.raw(part.column("text"))
            for a, b in T.slices(at, most):
                held[r].append((part.column("doc_id").slice(a, b - a), part.column("text").slice(a, b - a)))
                volume[r] += int(at[b] - at[a])
                if volume[r] >= most:
                    got = taken(r)
                    if only in (None, r):
                        yield number, r, *got
                    number += 1
    for r in held:
        if held[r]:
            got = taken(r)
            if only in (None, r):
                yield number, r, *got
            number += 1


class _Grams:
    """A slice's tokens as indices into its distinct n-grams, which are in ascending order of (range, hash). There are 2**bits ranges."""

    def __init__(self, text: pa.Array, bits: int, order: int):
        data, at = T.raw(text)
        h, first = T.word_hashes(data, at)
        n = np.diff(first)
        self.first = first + np.arange(len(first))
        seq = np.full(len(h) + len(n), _END, np.uint64)
        seq[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
        prev = np.empty_like(seq)
        prev[1:] = seq[:-1]
        if len(seq):
            prev[self.first[:-1]] = _END
        one, self.one_at, self.one_count = np.unique(seq, return_inverse=True, return_counts=True)
        two = T.mix(prev * np.uint64(3) ^ T.mix(seq + _SALT))
        self.three = None
        if order == 3:
            before = np.empty_like(two)
            before[1:] = two[:-1]
            if len(seq):
                before[self.first[:-1]] = _END
            three = T.mix(before * np.uint64(5) ^ T.mix(seq + _SALT + _SALT))
            del before
            self.three, self.three_at, self.three_count = np.unique(three, return_inverse=True, return_counts=True)
            del three
        two, self.two_at, self.two_count = np.unique(two, return_inverse=True, return_counts=True)
        self.prev_at = np.searchsorted(one, prev)
        self.bits = bits
        if order == 3:
            self.three_edge = self._edges(self.three)
        self.one, self.one_edge = one, self._edges(one)
        self.two, self.two_edge = two, self._edges(two)
        #: A sum over all n-grams, by which two readings of a slice are told apart.
        total = sum(int(T.mix(x ^ _SALT).sum(dtype=np.uint64)) for x in (one, two, *([self.three] if order == 3 else [])))
        self.check = (total + (1 << 63)) % (1 << 64) - (1 << 63)

    def _edges(self, keys: np.ndarray) -> np.ndarray:
        """Where each range begins: a hash's high bits name its range."""
        return np.append(np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else np.zeros(1, np.int64), len(keys))


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.astype("<u4" if a.max(initial=0) < 1 << 32 else "<u8").tobytes(), 1) + (b"4" if a.max(initial=0) < 1 << 32 else b"8")


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b[:-1]), "<u" + b[-1:].decode()).astype(np.int64)


def _six(keys: np.ndarray, bits: int) -> bytes:
    """Ascending hashes of one range, 48 bits behind the `bits` that name it, as gaps: the number of keys, then six planes of bytes.

    A gap's higher bytes are mostly zero, so their planes are compressed; the lower ones are noise.
    """
    n = len(keys)
    short = keys.astype("<u8") << np.uint64(bits) >> np.uint64(16)
    gap = np.diff(short, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    high = zlib.compress(np.ascontiguousarray(gap[:, 3:6].T).tobytes(), 1)
    return n.to_bytes(4, "little") + np.ascontiguousarray(gap[:, :3].T).tobytes() + high


def _unsix(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    gap = np.zeros((n, 8), np.uint8)
    gap[:, :3] = np.frombuffer(b, np.uint8, 3 * n, 4).reshape(3, n).T
    gap[:, 3:6] = np.frombuffer(zlib.decompress(b[4 + 3 * n :]), np.uint8).reshape(3, n).T
    return np.cumsum(gap.view("<u8").ravel(), dtype=np.uint64)


_SENT = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("role", pa.int32()), ("one", pa.binary()), ("one_count", pa.binary()), ("two", pa.binary()), ("two_count", pa.binary()), ("three", pa.binary()), ("three_count", pa.binary()), ("check", pa.int64())])
_BACK = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("one", pa.binary()), ("two", pa.binary()), ("three", pa.binary()), ("one_deleted", pa.binary()), ("two_deleted", pa.binary()), ("three_deleted", pa.binary()), ("tokens", pa.int64()), ("deleted", pa.int64()), ("types", pa.int64()), ("check", pa.int64())])


def _send(most: int, bits: int, order: int):
    def run(batches):
        for number, role, _, text in _slices(batches, most):
            g = _Grams(text, bits, order)
            edges = [g.one_edge, g.two_edge, *([g.three_edge] if order == 3 else [])]
            cols: list[list] = [[] for _ in _SENT]
            held = 0
            for k in np.flatnonzero(sum(np.diff(e) for e in edges)).tolist():
                one, two = slice(g.one_edge[k], g.one_edge[k + 1]), slice(g.two_edge[k], g.two_edge[k + 1])
                row = [k, number, role, g.one[one].astype("<u8").tobytes(), b"" if role == HELD_OUT else _pack(g.one_count[one]), _six(g.two[two], bits), b"" if role == HELD_OUT else _pack(g.two_count[two]), None, None, g.check]
                if order == 3:
                    three = slice(g.three_edge[k], g.three_edge[k + 1])
                    row[-3:-1] = _six(g.three[three], bits), b"" if role == HELD_OUT else _pack(g.three_count[three])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                held += sum(len(x) for x in row if isinstance(x, bytes))
                if held > SENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SENT, strict=True)], schema=_SENT)
                    cols, held = [[] for _ in _SENT], 0
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SENT, strict=True)], schema=_SENT)

    return run


def _answer(table: pa.Table) -> pa.Table:
    role = table.column("role").to_numpy()

    def totals(name: str, read):
        keys = [read(b) for b in table.column(name).to_pylist()]
        counts = [_unpack(c) if len(c) else np.zeros(len(k), np.int64) for k, c in zip(keys, table.column(f"{name}_count").to_pylist(), strict=True)]
        edge = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        n, deleted = np.concatenate(counts), np.repeat(role == DELETED, np.diff(edge))
        size = int(at.max(initial=-1)) + 1
        # Sums of whole numbers below 2**53 are exact as doubles.
        total, part = (np.bincount(at, weights=w, minlength=size).astype(np.int64) for w in (n, n * deleted))
        packed = [_pack(total[at[a:b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        apart = [_pack(part[at[a:b]]) if r == DELETED else None for a, b, r in zip(edge[:-1], edge[1:], role, strict=True)]
        return packed, apart, int(total.sum()), int(part.sum()), int((total > 0).sum())

    one, one_deleted, tokens, deleted, types = totals("one", lambda b: np.frombuffer(b, "<u8"))
    two, two_deleted, *_ = totals("two", _unsix)
    three, three_deleted, *_ = totals("three", _unsix) if table.column("three").null_count == 0 else ([None] * len(two), [None] * len(two))
    k, chunks = table.column("range").to_pylist(), table.column("chunk").to_pylist()
    return pa.table([k + k[:1], chunks + [None], one + [None], two + [None], three + [None], one_deleted + [None], two_deleted + [None], three_deleted + [None], [None] * len(k) + [tokens], [None] * len(k) + [deleted], [None] * len(k) + [types], table.column("check").to_pylist() + [None]], schema=_BACK)


def _tag(most: int, only: int | None):
    schema = pa.schema([("chunk", pa.int64()), ("role", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for number, role, ids, text in _slices(batches, most, only):
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.full(n, role, np.int32)), ids, text.cast(pa.string())], schema=schema)

    return run


def _counts(docs: pa.Table, back: pa.Table, bits: int, deleted: bool, order: int, sent_order: int):
    """The slice's n-grams, and counts for each token (less the deleted part's): its own, the pair's, the context's and, of order 3, the triple's and its context's."""
    text = docs.column("text").combine_chunks()
    g = _Grams(text, bits, sent_order)
    back = back.sort_by("range")
    if set(back.column("check").to_pylist()) != {g.check}:
        raise RuntimeError("a slice of documents changed between two reads of the input; write the input to a table first")

    def read(name: str) -> np.ndarray:
        n = np.concatenate([_unpack(b) for b in back.column(name).to_pylist()])
        return n - np.concatenate([_unpack(b) for b in back.column(f"{name}_deleted").to_pylist()] or [np.zeros(0, np.int64)]) if deleted else n

    one, two = read("one"), read("two")
    c1, c2, ch = one[g.one_at], two[g.two_at], one[g.prev_at]
    if order == 2:
        return g, c1, c2, ch, None, None
    cgh = np.empty_like(c2)
    cgh[1:] = c2[:-1]
    first = g.first[:-1]
    cgh[first] = ch[first]  # the pair before a document's first token is as frequent as its end
    return g, c1, c2, ch, read("three")[g.three_at], cgh


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.floor(np.log2(context + 1.0))).astype(np.int64)


def _level(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        x = np.rint(-8 * np.log2(p))
    return np.where(p > 0, np.clip(x, 0, LEVELS - 2) + 1, 0).astype(np.int64)


def _pairs(c1, c2, ch, tokens: int, types: int, weights: np.ndarray) -> np.ndarray:
    """P(w | h)."""
    w = weights[_bucket(ch)]
    return w[:, 0] / (types + 1) + w[:, 1] * (c1 / max(tokens, 1)) + w[:, 2] * (c2 / np.maximum(ch, 1))


def _grid(bits: int, order: int, tokens: int, types: int, weights: np.ndarray | None):
    """Cells of the first step or, given its weights, of the second."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        _, c1, c2, ch, c3, cgh = _counts(docs, back, bits, True, 2 if weights is None else 3, order)
        if weights is None:
            code = (_bucket(ch) * LEVELS + _level(c2 / np.maximum(ch, 1))) * LEVELS + _level(c1 / max(tokens, 1))
        else:
            code = (_bucket(cgh) * LEVELS + _level(c3 / np.maximum(cgh, 1))) * LEVELS + _level(_pairs(c1, c2, ch, tokens, types, weights))
        code, n = np.unique(code, return_counts=True)
        return pa.table({"code": pa.array(code), "n": pa.array(n.astype(np.int64))})

    return run


def learn_share(code: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The share m of the longer context for each bucket by EM; a context that doesn't occur has none."""
    b, p3, p2 = code // LEVELS**2, code // LEVELS % LEVELS, code % LEVELS
    value = np.concatenate([[0.0], 2.0 ** (-np.arange(LEVELS - 1) / 8)])
    total, out = np.bincount(b, weights=n, minlength=BUCKETS), np.full(BUCKETS, 0.5)
    for _ in range(rounds):
        three, two = out[b] * value[p3], (1 - out[b]) * np.maximum(value[p2], 1e-300)
        # Half a token of each kind keeps every share within 0 and 1.
        out = np.where(total > 0, (np.bincount(b, weights=n * three / (three + two), minlength=BUCKETS) + 0.5) / (total + 1), out)
    seen = total[1:] > 0
    out[1:][~seen] = out[1:][seen].mean() if seen.any() else 0.5
    out[0] = 0.0
    return out


def learn_weights(code: np.ndarray, n: np.ndarray, types: int, rounds: int = 50) -> np.ndarray:
    """Weights (l0, l1, l2) of each bucket by EM over the grid's cells; a bucket without tokens gets the others' mean."""
    b, p2, p1 = code // LEVELS**2, code // LEVELS % LEVELS, code % LEVELS
    value = np.concatenate([[0.0], 2.0 ** (-np.arange(LEVELS - 1) / 8)])
    p = np.stack([np.full(len(code), 1.0 / (types + 1)), value[p1], value[p2]])
    out = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        share = out[b].T * p
        share *= n / share.sum(axis=0)
        got = np.stack([np.bincount(b, weights=s, minlength=BUCKETS) for s in share], axis=1)
        total = got.sum(axis=1, keepdims=True)
        # Half a token of each kind keeps every weight above zero.
        out = np.where(total > 0, (got + 0.5) / (total + 1.5), out)
    empty = np.bincount(b, weights=n, minlength=BUCKETS) == 0
    if not empty.all():
        out[empty] = out[~empty].mean(axis=0)
    return out


def _score(bits: int, tokens: int, types: int, weights: np.ndarray, share: np.ndarray | None):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        g, c1, c2, ch, c3, cgh = _counts(docs, back, bits, False, 2 if share is None else 3, 2 if share is None else 3)
        p = _pairs(c1, c2, ch, tokens, types, weights)
        if share is not None:
            m = share[_bucket(cgh)]
            p = m * (c3 / np.maximum(cgh, 1)) + (1 - m) * p
        at = g.first[:-1]
        add = lambda x: np.add.reduceat(x, at) if len(at) else x
        n = np.diff(g.first)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": pa.array(docs.column("role").to_numpy() == HELD_OUT),
                "n_tokens": pa.array(n.astype(np.int64)),
                "n_known": pa.array(add((c1 > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(n), tokens, np.int64)),
                "base_score": pa.array(add(np.log10((c1 + 1.0) / (tokens + types + 1.0)))),
                "score": pa.array(add(np.log10(p))),
            }
        )

    return run


def deleted_interpolation(docs: DataFrame, fold: int = 7, held_out: int = 2, deleted: int = 3, order: int = 3) -> DataFrame:
    """Scores of whole texts under a trigram model (or bigram, of order 2) of deleted interpolation.

    Documents whose crc32(doc_id as text) mod `fold` is `held_out` are scored but not learned
    from; those where it is `deleted` give the held-out counts of EM. Tokens are words
    (runs without ASCII white space, A-Z lower-cased) and an end. Returns, for each row of docs:
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score,
    both log10. A null text is empty: one token, the end. A null doc_id is learned from. An
    empty table gives an empty result. Repeated rows count each time. Other columns are ignored.
    docs is read several times and has to give the same rows in the same partitions: of files it does.
    Should it not, the run ends in an error, never in other scores.
    """
    if order not in (2, 3):
        raise ValueError(f"order {order}: 2 or 3 is taken")
    spark = docs.sparkSession
    rest = F.crc32(F.col("doc_id").cast("string")) % fold
    role = F.when(rest == held_out, HELD_OUT).when(rest == deleted, DELETED).otherwise(TRAIN).cast("int")
    docs = batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), role.alias("role")))
    split = "spark.sql.files.minPartitionNum"
    if not (spark.conf.get(split, None) or "").isdigit():
        # Else the number of cores decides how files are split, which changes with the executors.
        spark.conf.set(split, str(spark.sparkContext.defaultParallelism))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = int(min(SLICE_MOST, max(SLICE_LEAST, SLICE_ROOT * math.sqrt(size))))
    bits = (max(64, size * (order - 1) // 6 // RANGE_KEYS) - 1).bit_length()
    back = saved(docs.mapInArrow(T.tidied(_send(most, bits, order)), "range int, chunk long, role int, one binary, one_count binary, two binary, two_count binary, three binary, three_count binary, check long").groupBy("range").applyInArrow(T.tidied_group(_answer), "range int, chunk long, one binary, two binary, three binary, one_deleted binary, two_deleted binary, three_deleted binary, tokens long, deleted long, types long, check long"), "counts")
    tokens, apart, types = (int(x or 0) for x in back.agg(F.sum("tokens"), F.sum("deleted"), F.sum("types")).first())
    answers = back.filter("chunk IS NOT NULL")
    tagged = "chunk long, role int, doc_id long, text string"

    def beside(only: int | None, columns: list[str], f, schema: str) -> DataFrame:
        rows = docs.mapInArrow(T.tidied(_tag(most, only)), tagged)
        few = answers if only is None else answers.filter("one_deleted IS NOT NULL")
        return rows.groupBy("chunk").cogroup(few.select("chunk", "range", "check", *columns).groupBy("chunk")).applyInArrow(T.tidied_group(f), schema)

    names = ["one", "two", "three"]

    def cells(weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        have = names[: 2 if weights is None else 3]
        got = beside(DELETED, [*have, *(f"{x}_deleted" for x in have)], _grid(bits, order, tokens - apart, types, weights), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
        return got["code"].to_numpy(np.int64), got["n"].to_numpy(np.float64)

    weights = learn_weights(*cells(None), types)
    share = learn_share(*cells(weights)) if order == 3 else None
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return beside(None, names[:order], _score(bits, tokens, types, weights, share), schema)
