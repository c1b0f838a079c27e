"""Toxicity by a weighted finite-state grammar over clauses.

The lexicon is an Aho-Corasick automaton over whole words and stems; each of its insult patterns
has a weight. A clause that holds a pattern becomes a string of symbols, one for each word (`SYMBOLS`)
and one for each opening quote, which the composition of five transducers rewrites:

* insults: a pattern's symbol is marked as an insult that nothing is known of yet;
* threats: a verb of harm is one where a target stands within `NEAR` words of it, and nothing elsewhere;
* targets: an insult within `NEAR` words of a word for a person addressed or spoken of is targeted;
* negation: what follows a negating word within `NEAR` words is negated;
* reported speech: what follows a verb of saying or an opening quote is reported.

A target may follow its insult, so two of the transducers guess and check: they have an arc for either
case and states that demand, or forbid, a target among the next words. One path of the composition
accepts each clause, and its outputs name the kind of each match. A document's features are the weights
of its matches summed by kind; a logistic regression over them gives each kind's weight and the score.

The insult patterns and their weights are learned: words and stems whose share among documents
labelled as toxic is significantly larger. Labels come from a bounded sample and only from the rows
that may be learned from.
"""

from __future__ import annotations

import bisect
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._shared import batched, saved

#: Labelled documents that are learned from, and patterns kept, at most.
MOST_LABELLED, MOST_CANDIDATES, MOST_PATTERNS = 20_000, 4_000, 400
#: Lengths of stems, least toxic documents of a pattern, least log-likelihood ratio (G).
STEMS, LEAST_DOCS, LEAST_G = (3, 8), 4, 18.0
NEAR = 3
#: Fixed word lists, in English, French, German and Spanish.
TARGETS = frozenset("you your yours u he she they him her them his their tu toi vous ton votre il elle ils elles du dich dein deine ihr euch sie ihn usted ustedes ti él ella ellos".split())
NEGATIONS = frozenset("not no never nor neither without isn aren wasn don doesn didn pas jamais sans nicht kein keine nie niemals nunca jamás sin".split())
REPORTS = frozenset("said says say saying wrote writes quoted quote claimed claims called according dit disait écrit selon sagte sagt schrieb laut dijo dice escribió según".split())
THREATS = frozenset("kill hurt destroy punch stab shoot strangle burn tuer frapper détruire töten schlagen vernichten matar golpear destruir".split())
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;,:|\n]")
_QUOTES = "\"“«„"
_PIECE = re.compile(rf"[^\W\d_]+|[{_QUOTES}]")
#: Symbols of the words of a clause: a pattern, a verb of harm, a target, a negating word, a verb of saying, another word; and an opening quote.
SYMBOLS = INSULT, HARM, TARGET, NEGATION, REPORT, OTHER, QUOTE = "ihtnroq"
PATHS = ("plain", "targeted", "negated", "reported", "threat")


class Transducer:
    """arcs(state, symbol): (next state, output, weight) of each arc; final(state): whether a string may end there. The weights of a path multiply."""

    def __init__(self, start, arcs, final=lambda state: True):
        self.start, self.final, self._arcs = start, final, arcs
        self._seen: dict = {}

    def arcs(self, state, symbol: str) -> list[tuple]:
        key = (state, symbol)
        if key not in self._seen:
            self._seen[key] = list(self._arcs(state, symbol))
        return self._seen[key]

    def then(self, other: Transducer) -> Transducer:
        """The composition: the other one reads what this one writes."""

        def arcs(state, symbol):
            for p, out, v in self.arcs(state[0], symbol):
                for q, end, w in other.arcs(state[1], out):
                    yield (p, q), end, v * w

        return Transducer((self.start, other.start), arcs, lambda state: self.final(state[0]) and other.final(state[1]))

    def outputs(self, symbols) -> list[tuple[str, float]]:
        """What the accepting path of the largest weight writes, with each arc's weight; of equal ones, the first."""
        alive = {self.start: (1.0, None)}
        for symbol in symbols:
            after: dict = {}
            for state, (total, path) in alive.items():
                for q, out, w in self.arcs(state, symbol):
                    if q not in after or after[q][0] < total:
                        # Only marks are kept, so that a long clause costs no more than its matches.
                        after[q] = (total, (path, out, w) if out in MARKS else path)
            alive = after
        ends = [(-total, k, path) for k, (state, (total, path)) in enumerate(alive.items()) if self.final(state)]
        out, path = [], min(ends, key=lambda x: x[:2])[2] if ends else None
        while path:
            out.append(path[1:])
            path = path[0]
        return out[::-1]


#: Marks that the transducers write: an insult, no match after all, and the kinds of a match.
_FOUND, _NONE, _PLAIN, _TARGETED, _THREAT, _NEGATED, _REPORTED = "I-PVHNR"
MARKS = {_NONE: None, _PLAIN: "plain", _TARGETED: "targeted", _THREAT: "threat", _NEGATED: "negated", _REPORTED: "reported"}


def insults() -> Transducer:
    return Transducer(0, lambda state, x: [(0, _FOUND if x == INSULT else x, 1.0)])


def beside_target(symbol: str, near: str, far: str, weight: float = 1.0) -> Transducer:
    """Rewrites `symbol` as `near` where a target is within `NEAR` words before or after, else as `far`.

    A state is (words since the last target, words in which a target has to come yet, words in which none may).
    """

    def arcs(state, x):
        since, need, none = state
        if x == QUOTE:
            yield state, x, 1.0
            return
        if x == TARGET:
            if not none:
                yield (0, 0, 0), x, 1.0
            return
        if need == 1:
            return
        since, need, none = min(since + 1, NEAR + 1), max(need - 1, 0), max(none - 1, 0)
        if x != symbol:
            yield (since, need, none), x, 1.0
        elif since <= NEAR:
            yield (since, need, none), near, weight
        else:
            if none < NEAR:
                yield (since, need or NEAR, none), near, weight
            if not need:
                yield (since, need, NEAR), far, 1.0

    return Transducer((NEAR + 1, 0, 0), arcs, lambda state: not state[1])


def negation() -> Transducer:
    def arcs(left, x):
        if x == NEGATION:
            yield NEAR, x, 1.0
        else:
            yield left if x == QUOTE else max(0, left - 1), _NEGATED if left and MARKS.get(x) else x, 1.0

    return Transducer(0, arcs)


def reported_speech() -> Transducer:
    def arcs(inside, x):
        yield inside or x in (REPORT, QUOTE), _REPORTED if inside and MARKS.get(x) and x != _NEGATED else x, 1.0

    return Transducer(False, arcs)


def grammar() -> Transducer:
    """From the symbols of a clause to the kinds of its matches."""
    return insults().then(beside_target(HARM, _THREAT, _NONE)).then(beside_target(_FOUND, _TARGETED, _PLAIN)).then(negation()).then(reported_speech())


def features_of(text: str):
    """Words ('w$') and stems ('w*') of a text."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add(w + "$")
        out.update(w[:k] + "*" for k in range(STEMS[0], min(STEMS[1], len(w)) + 1))
    return out


class Grammar:
    """patterns: {'word$' or 'stem*': weight}."""

    def __init__(self, patterns: dict[str, float]):
        import ahocorasick

        self.machine = grammar()
        self.find = ahocorasick.Automaton()
        for p, weight in {**{t + "$": 1.0 for t in THREATS}, **patterns}.items():
            old = self.find.get(p[:-1], None)
            whole, threat = p[-1] == "$", p not in patterns
            # A stem covers the word that equals it.
            if old is None or (old[1] and not whole):
                self.find.add_word(p[:-1], (len(p) - 1, whole, weight, threat))
        self.find.make_automaton()

    def matches(self, low: str):
        """(start, weight, threat) of the longest pattern that begins at each word's start."""
        best: dict[int, tuple] = {}
        for end, (n, whole, weight, threat) in self.find.iter(low):
            start = end - n + 1
            if (start and low[start - 1].isalpha()) or (whole and end + 1 < len(low) and low[end + 1].isalpha()):
                continue
            if start not in best or n > best[start][0]:
                best[start] = (n, weight, threat)
        return [(s, w, t) for s, (_, w, t) in sorted(best.items())]

    def features(self, text: str) -> list[float]:
        """Weights summed by path, as logarithms, and their density. The time is in proportion to the text's length."""
        low = text.lower()
        found = self.matches(low)
        total = dict.fromkeys(PATHS, 0.0)
        signs = [m.start() for m in _CLAUSE.finditer(low)] if found else []
        k = 0
        while k < len(found):
            sign = bisect.bisect_left(signs, found[k][0])
            a, b = signs[sign - 1] + 1 if sign else 0, signs[sign] if sign < len(signs) else len(low)
            own = {}
            while k < len(found) and found[k][0] < b:
                own[found[k][0]] = found[k][1:]
                k += 1
            for path, weight in self.clause(low, own, a, b):
                total[path] += weight
        every = sum(v for p, v in total.items() if p != "negated")
        density = math.log1p(200 * every / (len(text) / 6 + 20)) if every else 0.0
        return [math.log1p(total[p]) for p in PATHS] + [density, float(every > 0)]

    def clause(self, low: str, matched: dict[int, tuple[float, bool]], a: int, b: int):
        """(path, weight) of each match in the clause low[a:b]."""
        symbols, weights = [], []
        for m in _PIECE.finditer(low, a, b):
            w = m[0]
            if m.start() in matched:
                weight, harm = matched[m.start()]
                symbols.append(HARM if harm else INSULT)
                weights.append(weight)
            else:
                symbols.append(QUOTE if w in _QUOTES else TARGET if w in TARGETS else NEGATION if w in NEGATIONS else REPORT if w in REPORTS else OTHER)
        for weight, (mark, factor) in zip(weights, self.machine.outputs(symbols), strict=True):
            if MARKS[mark]:
                yield MARKS[mark], weight * factor


def _count(batches):
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for f in features_of(text):
                counts.setdefault(f, [0, 0])[y] += 1
        if len(counts) > 500_000:
            yield _counted(counts)
            counts = {}
    if counts:
        yield _counted(counts)


def _counted(counts: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["f", "a", "b"])


def choose_patterns(rows, toxic: int, clean: int) -> dict[str, float]:
    """Of (feature, toxic documents, clean documents), the best of each family of stems, with log-odds as weights."""
    scored = []
    for f, a, b in rows:
        n = toxic + clean
        g = 0.0
        for seen, of in ((a, toxic), (b, clean), (toxic - a, toxic), (clean - b, clean)):
            col = a + b if seen in (a, b) and (seen, of) in ((a, toxic), (b, clean)) else n - a - b
            want = of * col / n
            g += 2 * seen * math.log(seen / want) if seen and want else 0.0
        weight = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        if g >= LEAST_G and weight > 1:
            scored.append((-round(g, 6), f[-1], -len(f), f, weight))
    out: dict[str, float] = {}
    for _, _, _, f, weight in sorted(scored):
        stem = f[:-1]
        if any(stem.startswith(o[:-1]) or o.startswith(stem) for o in out):
            continue
        out[f] = weight
        if len(out) == MOST_PATTERNS:
            break
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights, the constant last, by Newton's method with a ridge on all but the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pen * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(patterns: dict[str, float]):
    def run(batches):
        grammar = Grammar(patterns)
        for batch in batches:
            x = [grammar.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    return run


def _scored(patterns: dict[str, float], weights: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        grammar = Grammar(patterns)
        for batch in batches:
            texts = batch.column("text")
            for k in range(0, len(texts), 1024):
                x = np.array([grammar.features(t) for t in texts[k : k + 1024].to_pylist()])
                s = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[k : k + 1024], batch.column("held_out")[k : k + 1024], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=schema)

    return run


def learn(docs: DataFrame, labels: DataFrame, fold: int = 5, held_out: int = 0) -> tuple[dict[str, float], np.ndarray]:
    """Patterns and regression weights, from up to `MOST_LABELLED` labelled documents outside the held-out fold; of texts under one id, the one of least hash."""
    free = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold, F.lit(held_out)) != held_out
    ids = labels.filter(free & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    # One text for each id, so that ids that repeat in docs don't multiply the sample.
    sample = sample.groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("y", "t.text")
    sample = saved(sample, "sample")
    size = dict(sample.groupBy("y").count().collect())
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        share = 1.0 if toxic else 0.0
        return {}, np.append(np.zeros(len(PATHS) + 2), 4.0 * (2 * share - 1))
    counts = sample.mapInArrow(T.tidied(_count), "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = (F.col("a") + 0.5) * (clean + 1) / ((F.col("b") + 0.5) * (toxic + 1))
    rows = counts.filter((F.col("a") >= LEAST_DOCS) & (odds > 3)).orderBy(F.desc(F.col("a") * F.log(odds)), "f").limit(MOST_CANDIDATES).collect()
    patterns = choose_patterns([tuple(r) for r in rows], toxic, clean)
    got = sample.mapInArrow(T.tidied(_featured(patterns)), "y int, x array<double>").toPandas()  # MOST_LABELLED rows at most
    order = sorted(range(len(got)), key=lambda k: (got["y"][k], *got["x"][k]))
    return patterns, fit_logistic(np.array([got["x"][k] for k in order]), got["y"].to_numpy(float)[order])


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every row of docs.

    Labels whose crc32(doc_id as text) mod `fold` is `held_out` are never read; null labels and ids
    are left out, and of differing labels of one id the greater counts. A null text is empty; empty
    texts have the score of a text without patterns. If labels hold one class alone, or none, the
    score is constant. A null doc_id is not held out. Repeated rows give repeated rows; other columns
    are ignored.
    """
    patterns, weights = learn(batched(docs), labels, fold, held_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(T.tidied(_scored(patterns, weights)), "doc_id long, held_out boolean, score double, predicted int")
