"""N-gram Jaccard join by count-vector R-trees.

Each document becomes the set of its distinct k-word shingles. The sets' elements
are hashed into groups; the counts by group are a point, and the summed minima of
two points bound the sets' intersection. The index is a forest of R-trees over these
points, and every pair that it passes is verified:

1. One pass gives each document its set's size, a 64-bit identity of the set and
   its point of up to `MOST_GROUPS` groups; exact copies meet in one identity. The
   pass also sums a sketch of how frequent shingles are.
2. The forest's roots are the finest groups, one for each 64-bit hash. By the bound
   on summed minima, two sets that are linked share some roots among the rarest few of
   either, so a second pass deals a set's point to those trees alone, the sketch
   giving the order: passages that many documents share come last. Where no other
   point of a fitting size has come, a point leaves its tree again; a set that stays in
   fewer trees than it would share with the least set it could be linked with, leaves all.
3. In each tree the nodes' maxima bound the overlap, and leaves are joined pair by
   pair under the bound (`_rtree`). Trees over `CELL` points are cut into chunks
   that share some pivots; a second round compares what isn't connected to the
   tree's largest component by then with all chunks. Each task returns a spanning
   forest of its pairs, not the pairs.
4. The pairs' components hold every linked pair. A third pass fetches the sets of
   documents in components of two or more, cut into chunks in the same way; there
   the pairs of an R-tree over a component are verified exactly, but for pairs that
   verified links join already.
5. The verified links' components, by the least doc_id of their documents.

One tree over all points would not do: at a similarity of 0.8 or 0.9 the maxima of a
node of unrelated points exceed every bound but that on sizes, so its join tests
nearly all pairs of sets of like sizes. Sets over 64-bit hashes stand for the
shingles themselves.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._rtree import FAN, CountTree, Forest
from ._shared import batched, components, discard, saved

#: Groups of shingle hashes: the dimensions of the points in the tree. Two unrelated sets of n
#: elements differ by about sqrt(n * groups) in sum, and linked ones by less than a share of n, so
#: points of larger sets have up to `MOST_GROUPS` finer groups, which pairs are tested by as well.
GROUPS, MOST_GROUPS, PER_GROUP = 32, 256, 16
#: Each of the sketch's two rows has a counter for so many shingles, within limits; and the pieces in which it is summed.
LOAD, SKETCH_LEAST, SKETCH_MOST, PIECES = 256, 1 << 19, 1 << 22, 64
#: Points of a tree that one task joins, at most, and elements of sets; pivots that the chunks of a larger tree share.
CELL, ELEMENTS, PIVOTS = 768, 1 << 21, 32
#: Points, and elements of sets, that a task gets on average.
TASK_ROWS, TASK_ELEMENTS = 20_000, 1 << 21
#: Bits for each set in the filter by which the third pass chooses documents, and its least and most: beyond, it lets more sets through.
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 128, 1 << 16, 1 << 28


def _set_of(h: np.ndarray) -> int:
    """A 64-bit identity of a set, given its distinct hashes in ascending order."""
    with np.errstate(over="ignore"):
        x = np.array([T.mix(h).sum(dtype=np.uint64) * np.uint64(3) + np.uint64(len(h))], np.uint64)
    return int(T.mix(x).view(np.int64)[0])


def _groups(n: int) -> int:
    """Groups of the point of a set of n elements."""
    g = GROUPS
    while g < MOST_GROUPS and n >= PER_GROUP * g:
        g *= 2
    return g


def _point(h: np.ndarray) -> bytes:
    """Counts by group, in the narrowest width that holds them."""
    g = _groups(len(h))
    c = np.bincount((h & np.uint64(g - 1)).astype(np.int64), minlength=g)
    return c.astype(np.uint8 if c.max(initial=0) < 256 else np.uint16 if c.max() < 65536 else np.uint32).tobytes()


def _fine(blobs, sizes) -> list[np.ndarray]:
    """The points at their own number of groups."""
    return [np.frombuffer(b, f"<u{len(b) // _groups(int(n))}").astype(np.int32) for b, n in zip(blobs, sizes, strict=True)]


def _coarse(fine: list[np.ndarray]) -> np.ndarray:
    """The points folded to `GROUPS` groups."""
    return np.stack([x.reshape(-1, GROUPS).sum(axis=0) for x in fine])


def _close(x: np.ndarray, y: np.ndarray, need: int) -> bool:
    """Whether the summed minima of two points, at the coarser number of groups, reach `need`."""
    if len(x) != len(y):
        g = min(len(x), len(y))
        x, y = x.reshape(-1, g).sum(axis=0), y.reshape(-1, g).sum(axis=0)
    return int(np.minimum(x, y).sum()) >= need


def _sets(batches, k: int):
    """(doc_id column, row, set) of every row of the batches."""
    for batch in batches:
        text, at = T.raw(batch.column("text"))
        for a, b in T.slices(at):
            h, first = T.word_hashes(text[at[a] : at[b]], at[a : b + 1] - at[a])
            h, first = T.distinct_by_row(*T.shingle_hashes(h, first, k))
            for r in range(a, b):
                yield batch, r, h[first[r - a] : first[r - a + 1]]


def _counters(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters of shingles in the two rows of a sketch."""
    low = np.uint64(size - 1)
    return ((h >> np.uint64(40)) & low).astype(np.int64), ((h >> np.uint64(8)) & low).astype(np.int64)


def _profile(k: int, size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sid", pa.int64()), ("point", pa.binary()), ("piece", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        sketch = np.zeros((2, size), np.uint32)
        held: list[np.ndarray] = []
        waiting = 0
        rows: list[tuple] = []

        def count():
            for row, at in zip(sketch, _counters(np.concatenate(held), size), strict=True):
                row += np.bincount(at, minlength=size).astype(np.uint32)
            held.clear()
        ids, last = None, None

        def flush():
            d, n, s, p = zip(*rows, strict=True)
            x = len(rows)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int32()), pa.array(s, pa.int64()), pa.array(p, pa.binary()), pa.nulls(x, pa.int32()), pa.nulls(x, pa.int32()), pa.nulls(x, pa.binary())], schema=schema)

        for batch, r, h in _sets(batches, k):
            if batch is not last:
                ids, last = batch.column("doc_id").to_pylist(), batch
            if len(h):
                held.append(h)
                waiting += len(h)
                if waiting >= size:
                    count()
                    waiting = 0
                rows.append((ids[r], len(h), _set_of(h), _point(h)))
            else:
                rows.append((ids[r], 0, None, None))
            if len(rows) >= 4096:
                yield flush()
        if rows:
            yield flush()
        if held:
            count()
        if sketch.any():
            part = TaskContext.get().partitionId()
            for piece, c in enumerate(sketch.reshape(PIECES, -1)):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([piece], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1)])], schema=schema)

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = 0
    for x in table.column("counts"):
        c = np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        total = np.minimum(c + np.int64(0) + total, (1 << 32) - 1)
    return pa.table({"piece": table.column("piece")[:1], "part": table.column("part")[:1], "counts": pa.array([zlib.compress(total.astype(np.uint32).tobytes(), 1)], pa.binary())})


def _levels(profile: DataFrame, size: int) -> np.ndarray:
    """The sketch as quarter-octave levels, one byte for each counter: 2 * `SKETCH_MOST` bytes at most reach the driver and the executors."""
    schema = "piece int, part int, counts binary"
    rows = profile.filter("piece IS NOT NULL").select("piece", "part", "counts")
    some = rows.withColumn("part", F.expr("cast(part div 256 AS int)")).groupBy("piece", "part").applyInArrow(_summed, schema)
    got = some.groupBy("piece").applyInArrow(_summed, schema).select("piece", "counts").collect()
    total = np.zeros((PIECES, 2 * size // PIECES), np.uint32)
    for piece, counts in got:
        total[piece] = np.frombuffer(zlib.decompress(counts), np.uint32)
    return np.floor(np.log2(total.ravel() + 1.0) * 4).astype(np.uint8).reshape(2, size)


_DEALT = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("n", pa.int32()), ("sid", pa.int64()), ("short", pa.bool_())])


def shared_roots(n: int, num: int, den: int) -> int:
    """How many of its trees a set of n elements shares with any set that it is linked with and that is no smaller."""
    return 1 + n * (den - num) // (4 * den)


def _prefixes(k: int, num: int, den: int, levels, size: int):
    """The trees that each set's point is dealt to.

    Points of a tree that the sketch has for much larger than its counters' mean are dealt by a salt, too.
    """

    def run(batches):
        level = levels.value
        step = 2.0 ** ((np.arange(256)) / 4)
        most_rows = max(4 * CELL, 16 * step[int(np.median(level))])
        salts = np.where(step > most_rows, np.ceil(step / most_rows), 1).astype(np.int64)
        seen: set[int] = set()
        out: list[tuple] = []
        held = 0
        for _, _, h in _sets(batches, k):
            n = len(h)
            if not n or (sid := _set_of(h)) in seen:
                continue
            seen.add(sid)
            # Sets with an intersection of x or more share r of their first n - x + r elements in any one order.
            r = shared_roots(n, num, den)
            most = min(n, n - -(-num * n // den) + r)
            short = n - -(-2 * num * n // (num + den)) + r
            i, j = _counters(h, size)
            lv = np.minimum(level[0][i], level[1][j])
            if most < n:  # only the ranks up to `most` are sorted
                edge = np.partition(lv, most - 1)[most - 1]
                near = np.flatnonzero(lv <= edge)
                h, lv = h[near], lv[near]
            take = np.argsort(lv, kind="stable")[:most]
            of = salts[lv[take]]
            out.append((h[take].view(np.int64), np.where(of > 1, (sid & 0x7FFFFFFF) % of, -1).astype(np.int32), n, sid, short))
            held += len(take)
            if held >= 65536:
                yield _rows(out)
                out, held = [], 0
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    m = [len(x[0]) for x in out]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([x[0] for x in out])),
            pa.array(np.concatenate([x[1] for x in out])),
            pa.array(np.repeat(np.array([x[2] for x in out], np.int32), m)),
            pa.array(np.repeat(np.array([x[3] for x in out], np.int64), m)),
            pa.array(np.concatenate([np.arange(c) < x[4] for c, x in zip(m, out, strict=True)])),
        ],
        schema=_DEALT,
    )


def _meeting(num: int, den: int):
    """Of rows in the order of key, salt, n and sid, those that stand beside another set of a fitting size in their tree.

    Of the sizes that fit a set's, its neighbours' are the nearest, so only these are looked at.
    Rows with a salt stay: their tree goes on elsewhere.
    """

    def chosen(c: list[np.ndarray]) -> pa.RecordBatch:
        key, salt, n, sid, short = c
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        key, salt, n, sid, short = (x[new] for x in c)
        fits = np.zeros(len(key) + 1, bool)  # rows k - 1 and k
        fits[1:-1] = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1]) & (n[:-1].astype(np.int64) * den >= n[1:].astype(np.int64) * num)
        keep = fits[1:] | fits[:-1] | (salt >= 0)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, salt, n, sid, short)], schema=_DEALT)

    def run(batches):
        held = None
        for batch in batches:
            c = [batch.column(f.name).to_numpy(zero_copy_only=False) for f in _DEALT]
            if not len(c[0]):
                continue
            c = [np.concatenate(x) for x in zip(held, c, strict=True)] if held else c
            last = int(np.searchsorted(c[0], c[0][-1], "left"))  # the last key may go on in the next batch
            if last:
                yield chosen([x[:last] for x in c])
            held = [x[last:] for x in c]
        if held:
            yield chosen(held)

    return run


def _linked(light: DataFrame, whole_rows, run, elements: bool) -> DataFrame:
    """Edges (u, v) by which `run` connects the rows of each block, in two rounds.

    light: block, c (its sets), e (their elements), sid, n; whole_rows adds what run reads to some of these rows.

    Blocks over `CELL` sets, or over `ELEMENTS` elements if these are what a task holds, are cut into
    chunks that some pivots belong to besides, as many on average as `PIVOTS`. The second round takes
    a cut block's sets outside its largest component so far, if there are any, against all its sets.
    """
    size = F.greatest(F.col("c") / CELL, F.col("e") / ELEMENTS) if elements else F.col("c") / CELL
    light = light.withColumn("chunks", F.ceil(size).cast("int"))
    total = light.agg(F.count("*"), F.sum(F.col("n").cast("long")), F.max("chunks")).first()
    tasks = max(1, -(-(total[1] or 0) // TASK_ELEMENTS) if elements else -(-total[0] // TASK_ROWS), light.sparkSession.sparkContext.defaultParallelism)
    own = lambda n, seed: F.expr(f"cast(pmod(xxhash64(sid, block, {seed}), {n}) AS int)")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    pivot = F.expr("pmod(xxhash64(sid, block, 0), c)") < PIVOTS

    def dealt(df: DataFrame) -> DataFrame:
        return df.drop("c", "e", "chunks").withColumn("task", F.expr(f"pmod(xxhash64(block, a, b), {tasks})")).groupBy("task").applyInArrow(run, "u long, v long")

    once = F.explode(F.when((F.col("chunks") > 1) & pivot, every).otherwise(F.array(own("chunks", 1))))
    edges = dealt(whole_rows(light).withColumn("a", once).withColumn("b", F.lit(0)).withColumn("r", F.col("sid")))
    if (total[2] or 0) <= 1:
        return edges
    edges = saved(edges, "first")
    cut = light.filter("chunks > 1").join(components(edges).select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("r", F.coalesce("root", "sid")).drop("root")
    cut = saved(cut, "labelled")
    most = cut.groupBy("block", "r").agg(F.count("*").alias("k")).groupBy("block").agg(F.max_by("r", F.struct("k", "r")).alias("main"), (F.sum("k") - F.max("k")).alias("rest")).filter("rest > 0")
    most = saved(most, "most")
    if most.isEmpty():
        return edges
    cut = whole_rows(saved(cut.join(most, "block"), "cut")).withColumn("parts", F.ceil(F.greatest(F.col("rest") / CELL, F.col("rest") * F.col("chunks") / F.col("c"))).cast("int"))
    inside = cut.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("a", own("chunks", 1))
    outside = cut.filter("r <> main").withColumn("a", F.explode(every)).withColumn("b", own("parts", 2))
    both = inside.unionByName(outside).drop("main", "rest", "parts")
    return edges.unionByName(dealt(both))


def _blocks(table: pa.Table):
    """The rows of each block and chunk of a task, a set once."""
    b = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("sid", "b", "a", "block")])
    order = np.lexsort(b)
    b = b[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (b[:, 1:] != b[:, :-1]).any(axis=0)
    order, b = order[new], b[1:, new]
    edge = np.flatnonzero(np.concatenate([[True], (b[:, 1:] != b[:, :-1]).any(axis=0)])) if len(order) else np.zeros(0, np.int64)
    return order, edge, np.diff(np.append(edge, len(order)))


def _started(r: np.ndarray) -> Forest:
    """A forest in which rows of one component are joined."""
    forest = Forest(len(r))
    first: dict[int, int] = {}
    for k, x in enumerate(r.tolist()):
        forest.join(first.setdefault(x, k), k)
    return forest


def _forest(sid: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """A star for each component of the pairs (a, b) of indices into sid: each node's edge to its root."""
    up = np.arange(len(sid))
    while len(a):
        x, y = up[a], up[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            break
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]
    k = np.flatnonzero(up != np.arange(len(up)))
    return pa.table({"u": pa.array(sid[k]), "v": pa.array(sid[up[k]])})


def _candidates(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        sid, at = np.unique(table.column("sid").to_numpy(), return_inverse=True)
        n, short = table.column("n").to_numpy().astype(np.int64), table.column("short").to_numpy(zero_copy_only=False)
        blobs, first = table.column("point"), np.unique(at, return_index=True)[1]
        size = n[first]
        fine = _fine([blobs[int(i)].as_py() for i in first], size)
        points = _coarse(fine)
        root = table.column("r").to_numpy()
        order, edge, count = _blocks(table)
        got: list[tuple] = []

        def test(i: np.ndarray, j: np.ndarray) -> None:
            """i, j: rows of the table."""
            ni, nj = n[i], n[j]
            ok = np.where(ni == nj, short[i] | short[j], np.where(ni < nj, short[i], short[j])) & (np.minimum(ni, nj) * den >= np.maximum(ni, nj) * num) & (root[i] != root[j])
            code = np.unique(np.minimum(at[i[ok]], at[j[ok]]) * len(sid) + np.maximum(at[i[ok]], at[j[ok]]))
            for k in range(0, len(code), 1 << 17):
                a, b = np.divmod(code[k : k + (1 << 17)], len(sid))
                need = -(-(num * (size[a] + size[b])) // (num + den))
                ok = (np.minimum(points[a], points[b]).sum(axis=1) >= need) & (a != b)
                large = np.flatnonzero(ok & (np.minimum(size[a], size[b]) >= PER_GROUP * GROUPS))
                ok[large] = [_close(fine[x], fine[y], z) for x, y, z in zip(a[large], b[large], need[large], strict=True)]
                got.append((a[ok], b[ok]))

        for m in np.unique(count[(count > 1) & (count <= FAN)]):  # trees of one leaf, many at a time
            i, j = np.triu_indices(m, 1)
            begin = edge[count == m]
            step = max(1, (1 << 19) // len(i))
            for k in range(0, len(begin), step):
                base = begin[k : k + step, None]
                test(order[(base + i).ravel()], order[(base + j).ravel()])
        for begin, m in zip(edge[count > FAN], count[count > FAN], strict=True):
            own = order[begin : begin + m]
            tree = CountTree(points[at[own]], n[own], num, den)
            forest = _started(root[own])
            for a, b in tree.pairs():
                ok = np.where(n[own[a]] == n[own[b]], short[own[a]] | short[own[b]], np.where(n[own[a]] < n[own[b]], short[own[a]], short[own[b]]))
                need = tree.needed(n[own[a[ok]]], n[own[b[ok]]]).tolist()
                keep = [(x, y) for x, y, z in zip(a[ok].tolist(), b[ok].tolist(), need, strict=True) if forest.find(x) != forest.find(y) and _close(fine[at[own[x]]], fine[at[own[y]]], z) and forest.join(x, y)]
                if keep:
                    x, y = np.array(keep).T
                    got.append((at[own[x]], at[own[y]]))
        a, b = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 2
        return _forest(sid, a, b)

    return run


def _fetch(k: int, wanted):
    schema = pa.schema([("sid", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        bits = np.frombuffer(wanted.value, np.uint8)
        seen: set[int] = set()
        ids: list[int] = []
        blobs: list[bytes] = []
        held = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], schema=schema)

        for _, _, h in _sets(batches, k):
            if not len(h) or (sid := _set_of(h)) in seen:
                continue
            slot = sid % (8 * len(bits))
            if not bits[slot >> 3] >> (slot & 7) & 1:
                continue
            seen.add(sid)
            ids.append(sid)
            blobs.append(h.tobytes())
            held += len(blobs[-1])
            if held >= 1 << 20:
                yield batch()
                ids, blobs, held = [], [], 0
        if ids:
            yield batch()

    return run


def _wanted(nodes: DataFrame) -> bytes:
    """A filter over the sids: a set bit may be another's, a clear bit is certain. `FILTER_MOST` bits at most reach the driver."""
    count = nodes.count()
    size = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_BITS * count - 1).bit_length()))
    piece = size // 64

    def marked(table: pa.Table) -> pa.Table:
        slot = table.column("slot").to_numpy()
        bits = np.zeros(piece, bool)
        bits[slot % piece] = True
        return pa.table({"piece": pa.array([int(slot[0]) // piece], pa.int32()), "bits": pa.array([zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)], pa.binary())})

    out = bytearray(size // 8)
    slots = nodes.select(F.expr(f"pmod(sid, {size})").alias("slot")).distinct()
    for p, bits in slots.groupBy(F.expr(f"cast(slot / {piece} AS int)").alias("piece")).applyInArrow(lambda t: marked(t), "piece int, bits binary").collect():
        out[p * piece // 8 : (p + 1) * piece // 8] = zlib.decompress(bits)
    return bytes(out)


def _beside_filter(wanted, hit: bool):
    def run(batches):
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            slot = np.mod(ids.fill_null(0).to_numpy(zero_copy_only=False), 8 * len(bits))
            on = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(on == hit))

    return run


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs but those whose doc_id is among the ids (one column, doc_id). Rows with a null doc_id stay.

    A filter of bounded size over the ids lets most of the others through as they are; only rows that it
    stops are dealt, for a join that is exact.
    """
    ids = saved(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "ids")
    wanted = docs.sparkSession.sparkContext.broadcast(_wanted(ids.withColumnRenamed("doc_id", "sid")))
    batched(docs)
    clear, stopped = (docs.mapInArrow(T.tidied(_beside_filter(wanted, hit)), docs.schema) for hit in (False, True))
    return clear.unionByName(stopped.join(ids, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]))


def _verified(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        sid, n = table.column("sid").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        blobs, sets, root = table.column("point"), table.column("hashes"), table.column("r").to_numpy()
        order, edge, count = _blocks(table)
        links: list[tuple[int, int]] = []
        for begin, m in zip(edge[count > 1], count[count > 1], strict=True):
            own = order[begin : begin + m]
            h = [np.frombuffer(sets[int(i)].as_buffer(), np.uint64) for i in own]
            fine = _fine([blobs[int(i)].as_py() for i in own], n[own])
            tree = CountTree(_coarse(fine), n[own], num, den)
            forest = _started(root[own])
            for a, b in tree.pairs():
                need = tree.needed(n[own[a]], n[own[b]]).tolist()
                for x, y, z in zip(a.tolist(), b.tolist(), need, strict=True):
                    if forest.find(x) == forest.find(y) or not _close(fine[x], fine[y], z):
                        continue
                    small, large = (h[x], h[y]) if len(h[x]) <= len(h[y]) else (h[y], h[x])
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    if int((large[at] == small).sum()) * (num + den) >= num * (len(small) + len(large)):
                        forest.join(x, y)
            links += [(int(sid[own[x]]), int(sid[own[forest.find(x)]])) for x in range(m) if forest.find(x) != x]
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return run


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of the documents whose sets of distinct k-word shingles have a Jaccard similarity of num / den or more.

    Words are runs without ASCII white space, A-Z lower-cased. Returns doc_id, n_shingles and
    component_id, a row for each row of docs. A text of fewer than k words, but not none, has
    one shingle; null, empty and blank texts have none and are linked with nothing: their
    component is their own doc_id. A null doc_id is a document like any other, but is never the
    least of a component unless it has no other. Repeated rows and ids give repeated rows.
    Other columns are ignored.
    """
    if not 0 < num <= den:
        raise ValueError("the similarity must be in (0, 1]")
    spark = docs.sparkSession
    docs = batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = min(SKETCH_MOST, max(SKETCH_LEAST, 1 << math.ceil(math.log2(max(1, volume / 6 / LOAD)))))
    profile = saved(docs.mapInArrow(T.tidied(_profile(k, size)), "doc_id long, n int, sid long, point binary, piece int, part int, counts binary"), "profile")
    members = profile.filter("piece IS NULL").select("doc_id", "n", "sid")
    sets = saved(profile.filter("piece IS NULL AND sid IS NOT NULL").groupBy("sid").agg(F.first("n").alias("n"), F.first("point").alias("point"), F.min("doc_id").alias("least")), "sets")
    levels = spark.sparkContext.broadcast(_levels(profile, size))
    dealt = docs.select("text").mapInArrow(T.tidied(_prefixes(k, num, den, levels, size)), "key long, salt int, n int, sid long, short boolean")
    met = saved(dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "sid").mapInArrow(T.tidied(_meeting(num, den)), "key long, salt int, n int, sid long, short boolean").select(F.col("key").alias("block"), "n", "sid", "short"), "met")
    least = F.expr(f"1 + ((({num} * max(n) + {den - 1}) div {den}) * {den - num}) div {4 * den}")
    some = met.groupBy("sid").agg(F.count("*").alias("trees"), least.alias("least")).filter("trees >= least").select("sid")
    old, met = met, saved(met.join(some, "sid", "left_semi"), "met")
    discard(old)
    trees = met.groupBy("block").agg(F.count("*").alias("c"), F.sum(F.col("n").cast("long")).alias("e"), F.max("short").alias("any")).filter("c > 1 AND any").drop("any")
    trees = met.join(trees, "block")
    near = components(_linked(trees, lambda t: t.join(sets.select("sid", "point"), "sid"), T.tidied_group(_candidates(num, den)), False))
    clusters = saved(near.select(F.col("node").alias("sid"), F.col("root").alias("block")), "clusters")
    discard(near)
    sized = clusters.join(sets.select("sid", "n"), "sid")
    sized = saved(sized.join(sized.groupBy("block").agg(F.count("*").alias("c"), F.sum(F.col("n").cast("long")).alias("e")), "block"), "sized")

    def with_sets(t: DataFrame) -> DataFrame:
        wanted = spark.sparkContext.broadcast(_wanted(t.select("sid").distinct()))
        fetched = docs.select("text").mapInArrow(T.tidied(_fetch(k, wanted)), "sid long, hashes binary").dropDuplicates(["sid"])
        return t.join(sets.select("sid", "point"), "sid").join(fetched, "sid")

    links = components(_linked(sized, with_sets, T.tidied_group(_verified(num, den)), True))
    joined = links.withColumnRenamed("node", "sid")
    least = joined.join(sets.select("sid", "least"), "sid").groupBy("root").agg(F.min("least").alias("component_id"))
    # Written, so that the join with the members, where copies of one set can be many, stands alone and can be split.
    named = saved(sets.select("sid", "least").join(joined.join(least, "root"), "sid", "left").select("sid", F.coalesce("component_id", "least").alias("component_id")), "named")
    out = members.join(named, "sid", "left")
    out = saved(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "near")
    for table in (profile, sets, met, clusters, sized, links, named):
        discard(table)
    return out
