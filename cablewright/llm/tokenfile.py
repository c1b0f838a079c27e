"""Token ids in flat binary files.

The format, in one folder:

    ids-<shard>-<writer>.bin     the ids of the shard's documents, one after another, as
                                 little-endian unsigned integers: 16 bits if the vocabulary
                                 fits, else 32
    starts-<shard>-<writer>.bin  where each document's ids begin in that file, and the end of
                                 the last: little-endian unsigned 64 bits
    docs-<shard>-<writer>.bin    the documents' ids: little-endian signed 64 bits; a null
                                 doc_id is the least value
    manifest (a Parquet table)   shard, base (ids in all shards before), n_docs, n_ids, the
                                 width in bytes, and the name of the writer whose files count

Shards follow the ascending doc_id; bases are prefix sums of the shards' n_ids. A task that
is run twice writes under another name, and only the run whose rows reach the manifest counts,
so a lost executor leaves unused files at worst. Files go through pyarrow's file systems: local
ones are memory-mapped when read, of others only the parts that are asked for are read. A shard holds
`SHARD_BYTES` of text on average, or less where the session has more shuffle partitions.
"""

from __future__ import annotations

import itertools
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as T
from ._shared import batched, saved, work_dir

END = 1
_NULL = np.iinfo(np.int64).min
#: Bytes of text in a shard, on average at most, and ids that are read at once (a document's are, though, whatever they are).
SHARD_BYTES, READ_IDS = 256 << 20, 1 << 20
#: Words whose ids a worker keeps between slices: about 40 MB.
CACHE = 1_000_000
#: Letters with signs behind: two pieces to the tokenizer, or one. Such words are encoded many at a time.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)[.,;:!?%&#*$|]*")
TOGETHER = 1000


#: Texts that a tokenizer has to encode as their runs without ASCII white space, one after another, to be taken run by run.
_PROBES = ("low lower lowest", " a  b\tc\nd\x0be\x0cf\r\ng ", "don't stop... x1 2y", "l'été à la plage, déjà vu!", "\n\n", "日本 語 x")


class WordEncoder:
    """Encodes texts, where the tokenizer allows it by their distinct runs without ASCII white space.

    A tokenizer that splits at white space before it merges, and drops it, gives a text its runs' ids joined. Whether it
    does is tried when it is loaded, on texts with all kinds of white space; any other one is given whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.width = 2 if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        vocab = self.model.get_vocab(with_added_tokens=True)
        #: Whether an id ends a piece.
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        self.final[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        whole = lambda t: self.model.encode(t, add_special_tokens=False).ids
        self.by_runs = all(whole(t) == [i for run in re.findall(r"[^ \t-\r]+", t) for i in whole(run)] for t in _PROBES)
        self.known = np.zeros(0, np.uint64)
        self.ids, self.edge = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each text's ids begin and how many they are."""
        pieces = np.fromiter((0 if (m := _PLAIN.fullmatch(t)) is None else 1 + (m.end(1) < len(t)) for t in texts), np.int64, len(texts))
        begin, length = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        parts, total = [], 0
        alone = np.flatnonzero(pieces == 0).tolist()
        plain = np.flatnonzero(pieces)
        for k in range(0, len(plain), TOGETHER):
            own = plain[k : k + TOGETHER]
            ids = np.array(self.model.encode_batch_fast([" ".join([texts[i] for i in own])], add_special_tokens=False)[0].ids, np.uint32)
            ends, last = np.flatnonzero(self.final[ids]) + 1, np.cumsum(pieces[own])
            if len(ends) != last[-1]:
                alone += own.tolist()
                continue
            stop = ends[last - 1]
            length[own] = np.diff(stop, prepend=0)
            begin[own] = stop - length[own] + total
            parts.append(ids)
            total += len(ids)
        got = [e.ids for e in self.model.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        length[alone] = n
        begin[alone] = np.cumsum(n) - n + total
        parts.append(np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(n.sum())))
        return np.concatenate(parts), begin, length

    def encode(self, text: np.ndarray, at: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows with the end id behind each, and where each row's ids begin."""
        if not self.by_runs:
            data, at = text.tobytes(), at.tolist()
            rows = self.model.encode_batch_fast([data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], add_special_tokens=False)
            ids = [np.append(np.array(r.ids, np.uint32), np.uint32(end)) for r in rows]
            return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.cumsum([0, *map(len, ids)])
        exact, first = _case_hashes(text, at)
        starts, _ = T.words(text, at)
        rows = len(at) - 1
        if not len(exact):
            return np.full(rows, end, np.uint32), np.arange(rows + 1)
        distinct, where, inverse = np.unique(exact, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.known, distinct)
        slot[slot == len(self.known)] = 0
        old = self.known[slot] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        stops = T.ends(text, at)
        data = text.tobytes()
        fresh, fresh_begin, fresh_length = self._encode([data[starts[k] : stops[k]].decode("utf-8", "replace") for k in where[~old]])
        begin, length = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        begin[old], length[old] = self.edge[slot[old]], (self.edge[1:] - self.edge[:-1])[slot[old]]
        begin[~old], length[~old] = fresh_begin + len(self.ids), fresh_length
        pool = np.concatenate([self.ids, fresh])
        n = length[inverse]
        before = np.concatenate([[0], np.cumsum(n)])
        row_at = before[first]
        out = np.empty(before[-1] + rows, np.uint32)
        source = np.repeat(begin[inverse] - before[:-1], n) + np.arange(before[-1])
        ends = row_at[1:] + np.arange(rows)
        gap = np.ones(len(out), bool)
        gap[ends] = False
        out[gap] = pool[source]
        out[ends] = end
        self._keep(distinct, begin, length, pool, np.bincount(inverse, minlength=len(distinct)), old, slot)
        return out, row_at + np.arange(rows + 1)

    def _keep(self, distinct, begin, length, pool, count, old, slot) -> None:
        """Words stay until there are `CACHE` of them, a slice's commonest first."""
        new = np.flatnonzero(~old)
        room = max(0, CACHE - len(self.known))
        new = new if len(new) <= room else new[np.argsort(-count[new], kind="stable")[:room]]
        if not len(new):
            return
        keys = np.concatenate([self.known, distinct[new]])
        b, n = np.concatenate([self.edge[:-1], begin[new]]), np.concatenate([np.diff(self.edge), length[new]])
        order = np.argsort(keys)
        b, n = b[order], n[order]
        edge = np.concatenate([[0], np.cumsum(n)])
        self.ids = pool[np.repeat(b - edge[:-1], n) + np.arange(edge[-1])]
        self.known, self.edge = keys[order], edge


def _case_hashes(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, but with the case of letters."""
    starts, first = T.words(text, at)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    p, inverse = T._power(len(text))
    table = np.where(T.CLASSES["space"], T._BYTE, np.uint64(0))
    return T.mix(np.add.reduceat(table[text] * p[: len(text)], starts) * inverse[starts]), first


def _write(folder: str, tokenizer: str, end: int):
    schema = pa.schema([("shard", pa.int32()), ("writer", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())])

    def run(batches):
        from pyspark import TaskContext

        shard, writer = TaskContext.get().partitionId(), uuid.uuid4().hex
        encoder = _encoder(tokenizer)
        files, docs, total = None, 0, 0
        for batch in batches:
            text, at = T.raw(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(_NULL).to_numpy()
            for a, b in T.slices(at, 1 << 20):
                if files is None:
                    fs, path = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(path, recursive=True)
                    files = {k: fs.open_output_stream(f"{path}/{k}-{shard:06d}-{writer}.bin") for k in ("ids", "starts", "docs")}
                flat, begin = encoder.encode(text[at[a] : at[b]], at[a : b + 1] - at[a], end)
                files["ids"].write(flat.astype(f"<u{encoder.width}").tobytes())
                files["starts"].write((begin[:-1] + total).astype("<u8").tobytes())
                files["docs"].write(ids[a:b].astype("<i8").tobytes())
                docs, total = docs + b - a, total + int(begin[-1])
        if files is not None:
            files["starts"].write(np.array([total], "<u8").tobytes())
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([writer]), pa.array([docs], pa.int64()), pa.array([total], pa.int64()), pa.array([encoder.width], pa.int32())], schema=schema)

    return run


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = END) -> DataFrame:
    """Writes the ids of all texts of docs (doc_id, text) to `folder` in ascending doc_id order; returns the manifest.

    Null texts are empty: their ids are the end alone. Nulls in doc_id come first; rows of one
    doc_id are in the order of their texts' hashes. An empty table has an empty manifest.
    """
    rows = batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES), 1)
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    shards = saved(ordered.mapInArrow(T.tidied(_write(folder, tokenizer, end)), "shard int, writer string, n_docs long, n_ids long, width int"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return saved(shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))), "manifest")


class _Flat:
    """A flat file of unsigned or signed integers: any part of it as an array. Local files are memory-mapped, of others only the part is read."""

    def __init__(self, folder: str, name: str, dtype: str):
        fs, path = pafs.FileSystem.from_uri(folder)
        self.dtype = np.dtype(dtype)
        self.local = isinstance(fs, pafs.LocalFileSystem)
        if self.local:
            size = fs.get_file_info(f"{path}/{name}").size
            self.data = np.memmap(f"{path}/{name}", dtype=dtype, mode="r") if size else np.zeros(0, dtype)
        else:
            self.data = fs.open_input_file(f"{path}/{name}")

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.local:
            return np.asarray(self.data[part])
        size = self.dtype.itemsize
        return np.frombuffer(self.data.read_at((part.stop - part.start) * size, part.start * size), self.dtype)

    def close(self) -> None:
        if not self.local:
            self.data.close()


def read_shard(folder: str, shard: int, writer: str, width: int) -> tuple[_Flat, _Flat, _Flat]:
    """The doc_ids, the starts (one more than documents) and the ids of a shard."""
    name = f"{shard:06d}-{writer}.bin"
    return _Flat(folder, f"docs-{name}", "<i8"), _Flat(folder, f"starts-{name}", "<u8"), _Flat(folder, f"ids-{name}", f"<u{width}")


def documents_of(files: tuple[_Flat, _Flat, _Flat], n_docs: int):
    """(doc_ids, starts, ids) of some documents at a time; the starts have one more, and are counted in the shard."""
    docs, starts, ids = files
    for a in range(0, n_docs, 8192):
        own, begin = docs[a : min(a + 8192, n_docs)], starts[a : min(a + 8192, n_docs) + 1].astype(np.int64)
        k = 0
        while k < len(own):
            end = max(k + 1, int(np.searchsorted(begin, begin[k] + READ_IDS, "right")) - 1)
            yield own[k:end], begin[k : end + 1], ids[int(begin[k]) : int(begin[end])]
            k = end


def _read(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files = read_shard(folder, row["shard"], row["writer"], row["width"])
                for own, begin, ids in documents_of(files, row["n_docs"]):
                    at = (begin - begin[0]).tolist()
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == _NULL), pa.array(begin[:-1] + row["base"]), pa.array(np.diff(begin)), pa.array(crc, pa.int64())], schema=schema)
                for f in files:
                    f.close()

    return run


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, from the files."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return manifest.select("shard", "writer", "width", "base", "n_docs").repartition(n, "shard").mapInArrow(T.tidied(_read(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Writes docs with `write_tokens` (to the shared folder unless one is given) and reads the files back with `read_tokens`."""
    spark = docs.sparkSession
    folder = folder or f"{work_dir(spark)}/tokens"
    return read_tokens(spark, write_tokens(docs, folder, tokenizer or default_tokenizer(), end), folder)
