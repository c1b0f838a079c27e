"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells of (source, language, topic) by their words. Raking scales the
cells' weights in turn until their margins meet the targets; the cells' weights then give each
document a probability, and a hash of its id decides.

Where no target is given, a margin's share is in proportion to a power of what is there. A topic
is the docs' own where they have a topic column. Elsewhere `fit_topics` groups the vocabulary by
which words occur in the same documents, and a document's topic is the one whose words it has most of.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._shared import batched, discard, saved

MARGINS = ("source", "lang", "topic")
#: Topics, words of the vocabulary, and the least bytes of such a word.
TOPICS, VOCABULARY, LONG = 16, 4096, 6
#: A vocabulary word is in so many documents at least, and in one of so many at most.
LEAST_DOCS, RARE = 2, 10
#: Rounds of raking, each over all margins.
ROUNDS = 12
#: Powers of the margins' shares, by default: less than 1 evens them out.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Share of all words that the sample should have, and the sample's seed.
FRACTION, SEED = 0.5, "mix"
#: Cells that the driver rakes and broadcasts; more of them are raked by Spark, to the same weights, and joined.
MOST_CELLS = 200_000
#: Distinct words that a task holds before it sends them on.
HELD_WORDS = 1_000_000
_BLANK = " \t\n\x0b\f\r"


class Topics:
    """Words grouped around the commonest ones.

    words: hashes of the vocabulary. The first `seeds` of them may be topics; names are those of the topics that are.
    topic_of: the topic of each word, or -1.
    """

    def __init__(self, words: np.ndarray, seeds: int):
        self.order = np.argsort(words)
        self.words, self.seeds = words[self.order], seeds
        self.names: list[str] = []
        self.topic_of = np.full(len(words), -1)

    def found(self, text: np.ndarray, at: np.ndarray):
        """(row, word, begin, end) of every vocabulary word in the rows' texts."""
        h, starts, ends, row = long_words(text, at)
        if not len(h) or not len(self.words):
            return (np.zeros(0, np.int64),) * 4
        slot = np.searchsorted(self.words, h)
        slot[slot == len(self.words)] = 0
        hit = self.words[slot] == h
        return row[hit], self.order[slot[hit]], starts[hit], ends[hit]

    def name(self, text: np.ndarray, at: np.ndarray, names: dict[int, str]):
        """As `found`; names gets the words of seeds that it lacks."""
        row, word, starts, ends = self.found(text, at)
        for k in np.flatnonzero(word < self.seeds).tolist():
            if (w := int(word[k])) not in names:
                names[w] = text[starts[k] : ends[k]].tobytes().lower().decode("utf-8", "replace")
        return row, word, starts, ends

    def together(self, text: np.ndarray, at: np.ndarray, names: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
        """(word * seeds + seed, rows that have both); names gets the words of seeds that it lacks."""
        row, word, _, _ = self.name(text, at, names)
        size = max(len(self.words), 1)
        row, word = np.divmod(np.unique(row * size + word), size)
        seed = word < self.seeds
        # The seeds of each row stand beside each of its words.
        begin, many = np.searchsorted(row[seed], row, "left"), np.bincount(row[seed], minlength=len(at))[row]
        at_seed = np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.unique(np.repeat(word, many) * self.seeds + word[seed][at_seed], return_counts=True) if many.sum() else (np.zeros(0, np.int64),) * 2

    def of_rows(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The topic whose words each row has most of, of equals the commoner; -1 without any."""
        row, word, _, _ = self.found(text, at)
        topic = self.topic_of[word]
        row, topic = row[topic >= 0], topic[topic >= 0]
        k = max(len(self.names), 1)
        n = np.bincount(row * k + topic, minlength=(len(at) - 1) * k).reshape(-1, k)
        return np.where(n.any(axis=1), n.argmax(axis=1), -1)


def long_words(text: np.ndarray, at: np.ndarray):
    """Hash, begin, end and row of every word of `LONG` bytes or more."""
    h, first = T.word_hashes(text, at, "alnum")
    starts, _ = T.words(text, at, "alnum")
    ends = T.ends(text, at, "alnum")
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    keep = ends - starts >= LONG
    return h[keep], starts[keep], ends[keep], row[keep]


def _texts(batches):
    """(batch, first row, last row, bytes, offsets) of every slice."""
    for batch in batches:
        text, at = T.raw(batch.column("text"))
        for a, b in T.slices(at):
            yield batch, a, b, text[at[a] : at[b]], at[a : b + 1] - at[a]


def _merged_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)  # exact below 2**53


def _document_counts(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def sent(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "docs"])

    for _, _, _, text, at in _texts(batches):
        h, _, _, row = long_words(text, at)
        h, _ = T.distinct_by_row(h, np.searchsorted(row, np.arange(len(at))))
        held.append(np.unique(h, return_counts=True))
        if sum(len(k) for k, _ in held) >= HELD_WORDS:
            held = [_merged_counts(held)]
            if len(held[0][0]) >= HELD_WORDS // 2:
                yield sent(*held.pop())
    if held:
        yield sent(*_merged_counts(held))


def _beside(model: Topics):
    def run(batches):
        names: dict[int, str] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, _, _, text, at in _texts(batches):
            held.append(model.together(text, at, names))
            if sum(len(k) for k, _ in held) >= HELD_WORDS:
                held = [_merged_counts(held)]
        code, n = _merged_counts(held) if held else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n), pa.nulls(len(code), pa.string())], ["code", "n", "name"])
        yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.int64()), pa.nulls(len(names), pa.int64()), pa.array(list(names.values()), pa.string())], ["code", "n", "name"])

    return run


def _names(model: Topics):
    def run(batches):
        names: dict[int, str] = {}
        for _, _, _, text, at in _texts(batches):
            if len(names) < model.seeds:
                model.name(text, at, names)
        yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.int64()), pa.array(list(names.values()), pa.string())], ["code", "name"])

    return run


def fit_topics(docs: DataFrame) -> Topics:
    """Topics from all texts of docs.

    The vocabulary has the words that most documents hold, but for those that more than one in `RARE` holds:
    `VOCABULARY` of them, or fewer, for words that equally many documents hold come in or stay out together.
    The commonest `TOPICS` of them, by their documents and then in the order of words, are the topics. Each
    word goes to the topic whose own word's documents hold it most often, in proportion; of equals, to the
    commoner topic. What reaches the driver is bounded by `VOCABULARY` and by it times `TOPICS`.
    """
    text = docs.select(F.col("text").cast("string").alias("text"))
    counts = text.mapInArrow(T.tidied(_document_counts), "h long, docs long").groupBy("h").agg(F.sum("docs").alias("docs"))
    rows = counts.filter((F.col("docs") >= LEAST_DOCS) & (RARE * F.col("docs") <= text.count())).orderBy(F.desc("docs")).limit(VOCABULARY + 1).collect()
    if len(rows) > VOCABULARY:
        rows = [r for r in rows if r.docs > rows[-1].docs]
    if not rows:
        return Topics(np.zeros(0, np.uint64), 0)
    least = rows[min(TOPICS, len(rows)) - 1].docs
    if (tied := sum(r.docs >= least for r in rows)) > TOPICS:
        # Only the tied words' names are fetched before the topics are chosen, so that pairs are counted for those alone.
        some = Topics(np.array([r.h for r in rows[:tied]], np.int64).view(np.uint64), tied)
        called = dict(text.mapInArrow(T.tidied(_names(some)), "code long, name string").groupBy("code").agg(F.min("name").alias("name")).collect())
        order = sorted(range(tied), key=lambda k: (-rows[k].docs, called[k].encode()))
        rows = [rows[k] for k in order] + rows[tied:]
    docs_of = np.array([r.docs for r in rows], np.int64)
    model = Topics(np.array([r.h for r in rows], np.int64).view(np.uint64), min(TOPICS, len(rows)))
    share = np.zeros((len(rows), model.seeds))
    names = {}
    together = text.mapInArrow(T.tidied(_beside(model)), "code long, n long, name string")
    for code, n, name in together.groupBy("code", "name").agg(F.sum("n").alias("n")).select("code", "n", "name").collect():
        if name is None:
            share[divmod(code, model.seeds)] = n / docs_of[code % model.seeds]
        else:
            names[code] = name
    topics = sorted(range(model.seeds), key=lambda k: (-docs_of[k], names[k].encode()))[:TOPICS]
    model.names, share = [names[k] for k in topics], share[:, topics]
    model.topic_of = np.where(share.any(axis=1), share.argmax(axis=1), -1)
    return model


def _with_topic(model: Topics, columns: list[str]):
    names = pa.array(["", *model.names])

    def run(batches):
        for batch, a, b, text, at in _texts(batches):
            topic = names.take(pa.array(model.of_rows(text, at) + 1))
            words = np.diff(T.words(text, at)[1]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in columns), topic, pa.array(words)], names=[*columns, "topic", "n_tokens"])

    return run


def _described(docs: DataFrame, model: Topics | None, whole: bool = False) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of each row, with nulls as ''; if whole, also the row itself."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")] if whole else []
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    d = docs.select(*own, "doc_id", named("source").alias("source"), named("lang").alias("lang"), *([named("topic").alias("topic")] if model is None else []), text)
    kept = [*(["own"] if whole else []), "doc_id", "source", "lang"]
    if model is not None:
        schema = d.select(*kept, F.lit("").alias("topic"), F.lit(0).cast("long").alias("n_tokens")).schema
        return d.mapInArrow(T.tidied(_with_topic(model, kept)), schema)
    bare = F.btrim("text", F.lit(_BLANK))
    return d.select(*kept, "topic", F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[ \t-\r]+", -1))).cast("long").alias("n_tokens"))


def _model(docs: DataFrame) -> Topics | None:
    return None if "topic" in docs.columns else fit_topics(batched(docs))


def _targets(shares: dict[str, float], power: float) -> dict[str, float]:
    raised = {k: v**power if v else 0.0 for k, v in shares.items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()} if total else raised


def rake(cells: list[tuple], targets: dict[str, dict[str, float]], rounds: int = ROUNDS) -> list[float]:
    """Weights of (source, lang, topic, tokens) cells, which sum to 1, after `rounds` rounds."""
    total = float(sum(c[3] for c in cells))
    w = np.array([c[3] / total for c in cells])
    codes = []
    for k, m in enumerate(MARGINS):
        names = sorted({c[k] for c in cells})
        at = {n: i for i, n in enumerate(names)}
        codes.append((np.array([at[c[k]] for c in cells]), np.array([targets[m].get(n, 0.0) for n in names])))
    for _ in range(rounds):
        for code, want in codes:
            have = np.bincount(code, weights=w, minlength=len(want))
            w = w * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[code]
    return w.tolist()


def _rake_frame(cells: DataFrame, targets: DataFrame, rounds: int) -> DataFrame:
    """The same in Spark, for any number of cells. targets: margin, name, want."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1  # without cells there is nothing to weigh
    w = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for _ in range(rounds):
        for m in MARGINS:
            have = w.groupBy(m).agg(F.sum("weight").alias("have"))
            scale = have.join(targets.filter(F.col("margin") == m).select(F.col("name").alias(m), "want"), m, "left").select(m, F.when(F.col("have") > 0, F.coalesce("want", F.lit(0.0)) / F.col("have")).otherwise(0.0).alias("scale"))
            w = w.join(scale, m).withColumn("weight", F.col("weight") * F.col("scale")).drop("scale")
        old, w = w, saved(w, "raked")
        if hasattr(old, "_saved_at"):
            discard(old)
    return w


def rate_for(tokens, weights, fraction: float = FRACTION) -> float:
    """The rate r for which the sum of min(tokens, r * weight) is `fraction` of all tokens; inf if none is."""
    cells = sorted((t / w, t, w) for t, w in zip(tokens, weights, strict=True) if w > 0 and t > 0)
    want = fraction * sum(tokens)
    full, rest = 0.0, sum(w for _, _, w in cells)
    for ratio, t, w in cells:
        r = (want - full) / rest if rest > 0 else float("inf")
        if r <= ratio:
            return r
        full, rest = full + t, rest - w
    return float("inf")


def probabilities(found: DataFrame, targets: dict[str, dict[str, float]] | None, fraction: float, rounds: int) -> DataFrame:
    """source, lang, topic, weight, probability of each cell with words, from described documents."""
    spark = found.sparkSession
    cells = saved(found.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    live = cells.filter("tokens > 0")
    if cells.limit(MOST_CELLS + 1).count() <= MOST_CELLS:
        rows = sorted(tuple(r) for r in live.select(*MARGINS, "tokens").collect())
        total = sum(r[3] for r in rows) or 1
        want = {}
        for k, m in enumerate(MARGINS):
            shares: dict[str, float] = {}
            for r in rows:
                shares[r[k]] = shares.get(r[k], 0) + r[3]
            given = (targets or {}).get(m)
            want[m] = _targets({n: given.get(n, 0.0) for n in shares}, 1.0) if given else _targets({n: v / total for n, v in shares.items()}, POWERS[m])
        weights = rake(rows, want, rounds) if rows else []
        rate = rate_for([r[3] for r in rows], weights, fraction)
        table = [(*r[:3], w, min(1.0, rate * w / r[3]) if w > 0 else 0.0) for r, w in zip(rows, weights, strict=True)]
        out = spark.createDataFrame(table, "source string, lang string, topic string, weight double, probability double")
        out._few = True  # MOST_CELLS rows at most
        return out
    parts = []
    for m in MARGINS:
        given = (targets or {}).get(m)
        share = live.groupBy(F.col(m).alias("name")).agg(F.sum("tokens").alias("t"))
        if given:
            share = share.join(spark.createDataFrame(list(given.items()), "name string, g double"), "name", "left").select("name", F.coalesce("g", F.lit(0.0)).alias("p"))
        else:
            share = share.select("name", F.pow(F.col("t").cast("double"), POWERS[m]).alias("p"))
        # Targets that name nothing that is there leave no weight, as `_targets` has it.
        norm = share.agg(F.sum("p")).first()[0] or 1.0
        parts.append(share.select(F.lit(m).alias("margin"), "name", (F.col("p") / F.lit(norm)).alias("want")))
    raked = _rake_frame(live, saved(parts[0].unionByName(parts[1]).unionByName(parts[2]), "targets"), rounds)
    rate = _rate(raked, fraction * float(live.agg(F.sum("tokens")).first()[0] or 0))
    return raked.select(*MARGINS, "weight", F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.lit(rate) * F.col("weight") / F.col("tokens"))).otherwise(0.0).alias("probability"))


def _rate(raked: DataFrame, goal: float) -> float:
    """As `rate_for`: each round adds the cells that the rate takes whole, until none is added."""
    rate = 0.0
    while True:
        whole = F.col("tokens") <= F.lit(rate) * F.col("weight")
        full, rest = raked.filter("weight > 0").agg(F.sum(F.when(whole, F.col("tokens")).otherwise(0)), F.sum(F.when(whole, 0.0).otherwise(F.col("weight")))).first()
        if not rest:
            return math.inf
        if (goal - float(full)) / rest <= rate:
            return rate
        rate = (goal - float(full)) / rest


def _drawn(found: DataFrame, table: DataFrame, seed: str) -> DataFrame:
    """found with weight, probability and sampled."""
    out = found.join(F.broadcast(table) if getattr(table, "_few", False) else table, list(MARGINS), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(16**13)
    return out.withColumn("sampled", u < F.col("probability"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION, seed: str = SEED, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight (of the cell), probability and sampled of every row of docs.

    targets: shares by name for any of source, lang and topic; names that docs lack are ignored, and
    names that targets lack get none. Words are runs without ASCII white space. Nulls and missing
    columns count as ''. A cell without words has weight 0 and probability 1; every cell that has a
    weight is kept whole if the fraction can't be met. Rows of one doc_id in one cell share their
    fate; a null doc_id is hashed as ''.
    """
    found = saved(_described(docs, _model(docs)), "described")
    return _drawn(found, probabilities(found, targets, fraction, rounds), seed).select("doc_id", *MARGINS, "n_tokens", "weight", "probability", "sampled")


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION, seed: str = SEED, rounds: int = ROUNDS) -> DataFrame:
    """The rows of docs that `mix` samples, with their own columns. Texts are dealt only where there are more than `MOST_CELLS` cells."""
    model = _model(docs)
    table = probabilities(_described(docs, model), targets, fraction, rounds)
    return _drawn(_described(docs, model, whole=True), table, seed).filter("sampled").select("own.*")
