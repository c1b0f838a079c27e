"""Benchmark decontamination with a generalised suffix automaton.

The automaton reads every benchmark item's words; each of its states stands for the
substrings that end at the same places. Documents are streamed through it word by word,
with the length of the longest match that ends at each word: a match of `window` words
marks those words as hit, and the state names the items. Only stretches of a document
whose neighbouring word pairs all occur in some item are streamed, since no match of the
lengths asked for can lie elsewhere.

Items are dealt to blocks of about `BLOCK_WORDS` words, each with its own automaton that a task builds.
A task that searches holds the automata of `GROUP_BLOCKS` blocks at most: a larger benchmark makes several
groups, one after the other, each with its own broadcast and its own pass over the documents. What the passes find is joined by the
text's hash, of 128 bits, before spans are merged and item ids are counted.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._shared import batched, saved

#: Words of benchmark items in one automaton.
BLOCK_WORDS = 400_000
#: Blocks whose automata a task holds at once: about 250 MB each.
GROUP_BLOCKS = 2
#: Characters of a word and what parts it from the next, on average at least.
WORD_CHARS = 4
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """A generalised suffix automaton of word sequences, with the windows that its states end.

    A window is `window` consecutive words of an item, or the whole of a shorter item.
    """

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        """items: (name, words as hashes)."""
        self.window = window
        self.vocab = np.unique(np.array([w for _, ws in items for w in ws], np.uint64))
        code = {int(w): k for k, w in enumerate(self.vocab)}
        coded = [(name, [code[w] for w in ws]) for name, ws in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        #: Names of the items that hold a window which ends at the state.
        self.full: dict[int, set[str]] = defaultdict(set)
        self.short: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        pairs = []
        for name, ws in coded:
            pairs += [a * len(self.vocab) + b for a, b in zip(ws, ws[1:], strict=False)]
            at, n = 0, 0
            for w in ws:
                at, n = self.step(at, n, w)
                if n >= window:
                    self.full[self.above(at, window)].add(name)
            if 0 < len(ws) < window:
                self.short[self.above(at, len(ws))][len(ws)].add(name)
        self.pairs = np.unique(np.array(pairs, np.int64))
        self.least = min((min(len(ws), window) for _, ws in coded), default=window)
        self.full, self.short = dict(self.full), {k: dict(v) for k, v in self.short.items()}

    def _extend(self, last: int, w: int) -> int:
        follow = self.next[last].get(w)
        if follow is not None:
            if self.len[follow] == self.len[last] + 1:
                return follow
            return self._split(last, w, follow)
        new = self._state(self.len[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, length: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.len.append(length)
        self.link.append(0)
        return len(self.len) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the substrings of q that are no longer than those of p with w behind."""
        copy = self._state(self.len[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def step(self, at: int, n: int, w: int) -> tuple[int, int]:
        """The state and the longest matching length after the next word."""
        while at and w not in self.next[at]:
            at = self.link[at]
            n = self.len[at]
        follow = self.next[at].get(w)
        return (follow, n + 1) if follow is not None else (0, 0)

    def above(self, at: int, n: int) -> int:
        """The state of the last n words of what `at` stands for."""
        while self.len[self.link[at]] >= n:
            at = self.link[at]
        return at

    def matches(self, ws: list[int]):
        """(end, length, names) of every window that ends in the word sequence."""
        at, n = 0, 0
        for k, w in enumerate(ws):
            at, n = self.step(at, n, w)
            if n >= self.window:
                yield k + 1, self.window, self.full.get(self.above(at, self.window), ())
            if self.short:
                up = at
                while up > 0:
                    for m, names in self.short.get(up, {}).items():
                        if m <= n:
                            yield k + 1, m, names
                    up = self.link[up]

    def stretches(self, h: np.ndarray, first: np.ndarray):
        """(row, first word, coded words) of the stretches in which a window may lie."""
        v = len(self.vocab)
        if not v or not len(h):
            return
        code = np.searchsorted(self.vocab, h)
        code[code == v] = 0
        known = self.vocab[code] == h
        pair = np.zeros(len(h), bool)  # word k and the one before
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        both = both[~np.isin(both, first)]
        if len(both) and len(self.pairs):
            x = code[both - 1].astype(np.int64) * v + code[both]
            at = np.searchsorted(self.pairs, x)
            at[at == len(self.pairs)] = 0
            pair[both] = self.pairs[at] == x
        begin = np.flatnonzero(known & ~pair)
        end = np.flatnonzero(known & ~np.append(pair[1:], False)) + 1
        keep = end - begin >= self.least
        row = np.searchsorted(first, begin[keep], "right") - 1
        for r, a, b in zip(row.tolist(), begin[keep].tolist(), end[keep].tolist(), strict=True):
            yield r, a, code[a:b].tolist()


def _hashes(text: str) -> list[int]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return [int(x) for x in T.word_hashes(data, np.array([0, len(data)]), "alnum")[0]]


def _built(window: int):
    def run(table: pa.Table) -> pa.Table:
        items = sorted(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True))
        items = [(name, ws) for name, text in items if (ws := _hashes(text))]
        data = pickle.dumps(Automaton(items, window))
        return pa.table({"block": table.column("block")[:1], "automaton": pa.array([data], pa.binary())})

    return run


def _groups(benchmark: DataFrame, window: int):
    """Broadcasts of pickled automata, `GROUP_BLOCKS` at most in each.

    Items are dealt to blocks by a hash, a task builds each block's automaton and writes it to the shared
    folder; the driver holds one group at a time.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (BLOCK_WORDS * WORD_CHARS)))
    dealt = rows.withColumn("block", F.expr(f"cast(pmod(xxhash64(item_id, text), {blocks}) AS int)"))
    built = saved(dealt.groupBy("block").applyInArrow(_built(window), "block int, automaton binary"), "automata")
    for first in range(0, blocks, GROUP_BLOCKS):
        part = built.filter((F.col("block") >= first) & (F.col("block") < first + GROUP_BLOCKS))
        yield spark.sparkContext.broadcast([bytes(r.automaton) for r in part.orderBy("block").collect()])


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("cleaned", pa.string())]
)
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start: long, end: long>>, cleaned string"


def _search(automata, share: int, cleaned: bool):
    def run(batches):
        loaded = [pickle.loads(b) for b in automata.value]
        for batch in batches:
            ids = batch.column("doc_id")
            text, at = T.raw(batch.column("text"))
            for a, b in T.slices(at):
                yield _judge(ids.slice(a, b - a), text[at[a] : at[b]], at[a : b + 1] - at[a], loaded, share, cleaned)

    return run


_FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("edges", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("names", pa.list_(pa.string()))])
_FOUND_DDL = "k1 long, k2 long, edges array<struct<a: long, b: long>>, names array<string>"


def _find(automata):
    """What one group of blocks finds: a row for each text with a hit, words counted from the text's first."""

    def run(batches):
        loaded = [pickle.loads(b) for b in automata.value]
        for batch in batches:
            text, at = T.raw(batch.column("text"))
            for a, b in T.slices(at):
                h, first = T.word_hashes(text[at[a] : at[b]], at[a : b + 1] - at[a], "alnum")
                edges, names = _edges(h, first, loaded)
                rows = sorted(edges)
                take = pa.array([a + r for r in rows], pa.int64())
                own = [[{"a": x - int(first[r]), "b": y - int(first[r])} for x, y in _joined(edges[r])] for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column("k1").take(take), batch.column("k2").take(take), pa.array(own, _FOUND.field("edges").type), pa.array([sorted(names[r]) for r in rows], _FOUND.field("names").type)], schema=_FOUND)

    return run


def _keys() -> list:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def _merged(docs: DataFrame, groups: list) -> DataFrame:
    """k1, k2, edges and names of each text that any of the groups hits. Copies of a text are one row."""
    keyed = docs.select(F.col("text").cast("string").alias("text"), *_keys())
    found = None
    for automata in groups:
        # Written, so that no more than one group is held anywhere.
        part = saved(keyed.mapInArrow(T.tidied(_find(automata)), _FOUND_DDL).groupBy("k1", "k2").agg(F.first("edges").alias("edges"), F.first("names").alias("names")), "found")
        automata.unpersist()
        found = part if found is None else found.unionByName(part)
    return found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("edges")).alias("edges"), F.flatten(F.collect_list("names")).alias("names"))


def _one_or_more(benchmark: DataFrame, window: int):
    """The first group, and an iterator over all groups if there are others."""
    groups = _groups(benchmark, window)
    first = next(groups)
    second = next(groups, None)
    return first, itertools.chain([first, second], groups) if second is not None else None


def _from_found(batch, a: int, b: int, first: np.ndarray):
    """The slice's edges and names from the joined columns."""
    edges, names = {}, {}
    for r, (e, x) in enumerate(zip(batch.column("edges").slice(a, b - a).to_pylist(), batch.column("names").slice(a, b - a).to_pylist(), strict=True)):
        if e:
            edges[r], names[r] = [(int(first[r]) + p["a"], int(first[r]) + p["b"]) for p in e], set(x)
    return edges, names


def _search_found(share: int, cleaned: bool):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            text, at = T.raw(batch.column("text"))
            for a, b in T.slices(at):
                _, first = T.words(text[at[a] : at[b]], at[a : b + 1] - at[a], "alnum")
                yield _result(ids.slice(a, b - a), text[at[a] : at[b]], at[a : b + 1] - at[a], first, *_from_found(batch, a, b, first), share, cleaned)

    return run


def _edges(h: np.ndarray, first: np.ndarray, automata):
    """(begin, end) of every window found, and the items' names, by row."""
    edges, names = defaultdict(list), defaultdict(set)
    for automaton in automata:
        for r, begin, ws in automaton.stretches(h, first):
            for end, length, found in automaton.matches(ws):
                edges[r].append((begin + end - length, begin + end))
                names[r].update(found)
    return edges, names


def _joined(edges) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(edges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _judge(ids, text: np.ndarray, at: np.ndarray, automata, share: int, cleaned: bool) -> pa.RecordBatch:
    h, first = T.word_hashes(text, at, "alnum")
    return _result(ids, text, at, first, *_edges(h, first, automata), share, cleaned)


def _result(ids, text: np.ndarray, at: np.ndarray, first: np.ndarray, edges: dict, names: dict, share: int, cleaned: bool) -> pa.RecordBatch:
    n = np.diff(first)
    rows = len(n)
    hit = np.zeros(rows, np.int64)
    spans: list[list] = [[] for _ in range(rows)]
    whole: list[str | None] = [None] * rows
    starts = T.words(text, at, "alnum")[0] if edges or cleaned else None
    for r, e in edges.items():
        joined = _joined(e)
        hit[r] = sum(b - a for a, b in joined)
        spans[r] = [{"start": a - int(first[r]), "end": b - int(first[r])} for a, b in joined]
        if cleaned:
            own, base = text[at[r] : at[r + 1]].tobytes(), int(at[r])
            inside = T.CLASSES["alnum"][text[at[r] : at[r + 1]]]
            parts, k = [], 0
            for a, b in joined:
                last = int(starts[b - 1]) - base
                stop = np.flatnonzero(~inside[last:])
                parts.append(own[k : int(starts[a]) - base])
                k = last + int(stop[0]) if len(stop) else len(own)
            whole[r] = b"".join([*parts, own[k:]]).decode("utf-8", "replace")
    if cleaned:
        for r in range(rows):
            if whole[r] is None:
                whole[r] = text[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace")
    found = [sorted(names.get(r, ())) for r in range(rows)]
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(n.astype(np.int64)),
            pa.array(hit),
            pa.array([len(x) for x in found], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]),
            pa.array((hit > 0) & (share * hit >= n)),
            pa.array(found, pa.list_(pa.string())),
            pa.array(spans, _SCHEMA.field("spans").type),
            pa.array(whole, pa.string()),
        ],
        schema=_SCHEMA,
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, cleaned: bool = False) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item.

    Words are runs of ASCII digits and letters and of other than ASCII characters, A-Z
    lower-cased. A window is `window` consecutive words of an item, or the whole of a shorter
    item. Returns, for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256 (of the
    item_ids as text, sorted and comma-joined), contaminated (n_hit > 0 and share * n_hit >=
    n_words), item_ids, spans (words from start up to end, merged) and, if `cleaned`, the text
    without its spans. Null and empty texts have no words; a null item_id is named ''. Items
    without words have no window; items of one id count once. An empty benchmark hits nothing.
    """
    docs = batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    only, groups = _one_or_more(benchmark, window)
    if groups is None:
        return docs.mapInArrow(T.tidied(_search(only, share, cleaned)), RESULT)
    rows = docs.select("doc_id", "text", *_keys()).join(_merged(docs, groups), ["k1", "k2"], "left").select("doc_id", "text", "edges", "names")
    return rows.mapInArrow(T.tidied(_search_found(share, cleaned)), RESULT)


def _drop(automata, share: int, column: str):
    def run(batches):
        loaded = [pickle.loads(b) for b in automata.value]
        for batch in batches:
            text, at = T.raw(batch.column(column))
            for a, b in T.slices(at):
                judged = _judge(pa.nulls(b - a, pa.int64()), text[at[a] : at[b]], at[a : b + 1] - at[a], loaded, share, False)
                keep = np.flatnonzero(~judged.column("contaminated").to_numpy(zero_copy_only=False))
                if len(keep):
                    yield batch.slice(a, b - a).take(pa.array(keep))

    return run


def _drop_found(share: int, at_text: int, names: list[str]):
    def run(batches):
        for batch in batches:
            own = batch.column("own").flatten()
            text, at = T.raw(own[at_text].cast(pa.string()))
            rows = pa.RecordBatch.from_arrays(own, names=names)
            for a, b in T.slices(at):
                _, first = T.words(text[at[a] : at[b]], at[a : b + 1] - at[a], "alnum")
                judged = _result(pa.nulls(b - a, pa.int64()), text[at[a] : at[b]], at[a : b + 1] - at[a], first, *_from_found(batch, a, b, first), share, False)
                keep = np.flatnonzero(~judged.column("contaminated").to_numpy(zero_copy_only=False))
                if len(keep):
                    yield rows.slice(a, b - a).take(pa.array(keep))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The rows of docs that `decontaminate` doesn't call contaminated, with all their columns."""
    only, groups = _one_or_more(benchmark, window)
    if groups is None:
        return batched(docs).mapInArrow(T.tidied(_drop(only, share, "text")), docs.schema)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    rows = docs.select(own, *_keys()).join(_merged(docs, groups), ["k1", "k2"], "left").select("own", "edges", "names")
    return rows.mapInArrow(T.tidied(_drop_found(share, docs.columns.index("text"), docs.columns)), docs.schema)
