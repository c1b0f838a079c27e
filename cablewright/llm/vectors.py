"""Vector codes: each part of a vector becomes the index of its nearest codebook entry.

A codebook has 256 entries at most, so the driver holds all of them, and nothing else. In each round
tasks assign their vectors' parts and send one sum for each entry, which Spark adds up. The nearest entry is found
by a vantage-point tree over a part position's entries: batches of parts go down it together, those leave a branch that
can't hold anything nearer. Distances are compared as whole numbers; the bounds on branches are roots, rounded so
that they only ever let in more, and a branch that may hold an equal distance is visited for its lower index.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import batched, saved

#: A leaf of a tree has this many entries at most.
LEAF = 8
#: More than the rounding of a root, a sum and a product together, as a share.
SLACK = 2.0**-48


def _distances(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared distances of all q to all e, exactly: by doubles where every whole number on the way fits them."""
    most = max((int(np.abs(x).max()) for x in (q, e) if x.size), default=0)
    if 4 * most * most * q.shape[1] < 2**53:
        a, b = q.astype(float), e.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return ((q[:, None, :] - e[None, :, :]) ** 2).sum(2)


def vantage_tree(entries: np.ndarray, ids: np.ndarray | None = None):
    """(ids, vectors) of a leaf; or (id, vector, children), each child with the least and largest distance from the vector."""
    ids = np.arange(len(entries)) if ids is None else ids
    if len(ids) <= LEAF:
        return ids, entries[ids]
    # The entry farthest from the first one parts the rest best.
    own = ids[int(_distances(entries[ids[:1]], entries[ids])[0].argmax())]
    rest = ids[ids != own]
    d = _distances(entries[own : own + 1], entries[rest])[0]
    order = np.argsort(d, kind="stable")
    children = []
    for part in np.array_split(order, 2):
        # Ids stay in ascending order, so that a leaf's first least distance has the lowest index.
        lo, hi = math.sqrt(int(d[part].min())) * (1 - SLACK), math.sqrt(int(d[part].max())) * (1 + SLACK)
        children.append((lo, hi, vantage_tree(entries, np.sort(rest[part]))))
    return own, entries[own : own + 1], children


def _visit(node, q: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
    """Lowers `best` and `index` of the rows by what is in the tree."""
    if not len(rows):
        return
    d = _distances(q[rows], node[1])
    if len(node) == 2:
        k = d.argmin(1)
        d, ids = d[np.arange(len(rows)), k], node[0][k]
    else:
        d, ids = d[:, 0], np.full(len(rows), node[0])
    better = (d < best[rows]) | ((d == best[rows]) & (ids < index[rows]))
    best[rows[better]], index[rows[better]] = d[better], ids[better]
    if len(node) == 3:
        far = np.sqrt(d.astype(float))
        inside = far <= (node[2][0][1] + node[2][1][0]) / 2
        for own, order in ((inside, (0, 1)), (~inside, (1, 0))):
            for k in order:
                lo, hi, child = node[2][k]
                least = np.maximum(far[own] * (1 - SLACK) - hi, lo - far[own] * (1 + SLACK))
                open_ = least <= np.sqrt(best[rows[own]].astype(float)) * (1 + SLACK)
                _visit(child, q, rows[own][open_], best, index)


def nearest(tree, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equally near ones), and the squared distance, of each part."""
    best, index = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), np.iinfo(np.int64).max)
    _visit(tree, parts, np.arange(len(parts)), best, index)
    return index, best


def _cut(column: pa.Array, size: int, parts: int) -> np.ndarray:
    """Vectors by row, part and component; zeros fill up the last part."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)
    return np.pad(x, ((0, 0), (0, -size % parts))).reshape(len(column), parts, -(-size // parts))


def _whole(x: Column, scale: int, most: int) -> Column:
    return F.floor(F.greatest(F.least(F.lit(scale) * x.cast("double"), F.lit(float(most))), F.lit(float(-most)))).cast("long")


def _sums(kept: DataFrame, books: list[np.ndarray], size: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and componentwise sum of what goes to each entry: no more rows reach the driver than there are entries."""
    parts, width = len(books), books[0].shape[1]

    def task(batches):
        n, total = np.zeros((parts, len(books[0])), np.int64), np.zeros((parts, len(books[0]), width), np.int64)
        trees = [vantage_tree(b) for b in books]
        for batch in batches:
            x = _cut(batch.column("x"), size, parts)
            for p, tree in enumerate(trees):
                index, _ = nearest(tree, x[:, p])
                n[p] += np.bincount(index, minlength=len(n[p]))
                np.add.at(total[p], index, x[:, p])
        p, e = n.nonzero()
        yield pa.RecordBatch.from_pydict({"part": p.astype(np.int32), "entry": e.astype(np.int32), "n": n[p, e], "total": pa.array(list(total[p, e]), pa.list_(pa.int64()))})

    found = kept.select("x").mapInArrow(task, "part int, entry int, n long, total array<long>")
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)])
    return {(r[0], r[1]): (r[2], list(r[3:])) for r in found.collect()}


def compress(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """Id, code, error, label_error, codebooks_sha256 of every vector that has no null or non-finite component.

    Components become floor(scale * x), parts are `parts` equal consecutive ones (zeros fill up the last one
    where the length can't be parted). Each codebook starts as the parts of the `entries` (256 at most) smallest ids and is
    replaced `rounds` times by the floors of its parts' means. code has two hex digits for each part, error is the sum
    of the parts' squared distances to their entries, label_error its sum over equal labels, nulls together.

    Equal ids start in the order of their vectors, null ids last. The first vector in that order gives the length; vectors of another
    length have neither code nor error, and no part in anything else. Whole numbers are held within the
    bound up to which squared distances fit a long (at 64 components 2^28, so |x| of 262,144). Fewer vectors than entries make a
    smaller codebook. Repeated rows count each time; empty vectors lie at a distance of 0; an empty table gives an empty result; other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits")
    v = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{column}`").alias("x"))
    v = v.filter("x IS NOT NULL").filter(~F.exists("x", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == math.inf)))
    first = v.orderBy(F.col("id").asc_nulls_last(), "x").limit(1).collect()
    size = len(first[0].x) if first else 0
    most = math.isqrt((2**62) // max(size, 1)) // 2
    # Kept once as whole numbers: every round reads them.
    whole = saved(v.select("id", "label", F.transform("x", lambda c: _whole(c, scale, most)).alias("x")), "whole")
    kept = batched(whole).filter(F.size("x") == size)
    start = kept.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    x = _cut(pa.array([r.x for r in start], pa.list_(pa.int64())), size, parts) if start else np.zeros((0, parts, 0), np.int64)
    books = [x[:, p].copy() for p in range(parts)]
    if size and start:
        for _ in range(rounds):
            for (p, e), (n, total) in _sums(kept, books, size).items():
                books[p][e] = [t // n for t in total]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b.tolist() for c in e).encode()).hexdigest()

    kinds = dict(zip(("id", "label"), (whole.schema[c].dataType for c in ("id", "label")), strict=True))
    schema = T.StructType([T.StructField(c, t) for c, t in kinds.items()] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def task(batches):
        trees = [vantage_tree(b) for b in books]
        for batch in batches:
            x = _cut(batch.column("x"), size, parts)
            found = [nearest(tree, x[:, p]) for p, tree in enumerate(trees)]
            codes = np.stack([i for i, _ in found], 1).astype(np.uint8).tobytes().hex()
            codes = [codes[2 * parts * k : 2 * parts * (k + 1)] for k in range(len(x))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(sum(d for _, d in found), pa.int64())], ["id", "label", "code", "error"])

    coded = saved(kept.mapInArrow(task, schema).unionByName(whole.filter(F.size("x") != size).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))), "codes")
    total = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = coded.join(total.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
