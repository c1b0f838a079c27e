"""Quality rules, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and word pairs are hashed into `BUCKETS` buckets. Two multinomials over the buckets are
counted: the target's from documents labelled as good, the raw one from all documents. A
document's score is the sum of log(target / raw) over its n-grams, divided by their number,
and the document stays if the score reaches a threshold.

Here a word of an n-gram is a run of letters and digits, or a run of other characters but
white space: so signs that stick to words count as such. Only DataFrame functions are used.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the multinomials: a table of this size is all that reaches the driver.
BUCKETS = 1 << 14
#: Documents labelled as good that the target's counts are taken from, at most.
MOST_TARGETS = 20_000
#: Log-likelihood ratio per n-gram below which a document goes.
THRESHOLD = -0.2
_BLANK = " \t\n\x0b\f\r"
_UNIT = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"


def _with_words(docs: DataFrame) -> DataFrame:
    """Adds w: the array of words."""
    bare = F.btrim("text", F.lit(_BLANK))
    return docs.withColumn("w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+", -1)))


def rule_columns(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to docs, whose text is not null.

    A repeated window is found by sorting the hashes of all windows, each with its position in
    the low bits; equal hashes are confirmed word by word.
    """
    keep = docs.columns
    d = _with_words(docs).withColumn("n_words", F.size("w").cast("long"))
    d = d.withColumn("bits", F.ceil(F.log2(F.col("n_words") + 2)).cast("int"))
    d = d.withColumn("h", F.expr("CASE WHEN n_words > 3 THEN transform(sequence(0, cast(n_words AS int) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) ELSE cast(array() AS array<bigint>) END"))
    # Most texts have no window twice: those are done here.
    d = d.withColumn("s", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> shiftleft(x, bits) | cast(i AS bigint))) ELSE cast(array() AS array<bigint>) END")).drop("h")
    same = "shiftright(x, bits) = shiftright(s[{0}], bits) AND w[cast(x & m AS int)] = w[cast(s[{0}] & m AS int)] AND w[cast(x & m AS int) + 1] = w[cast(s[{0}] & m AS int) + 1] AND w[cast(x & m AS int) + 2] = w[cast(s[{0}] & m AS int) + 2]"
    d = d.withColumn("m", F.expr("shiftleft(1L, bits) - 1")).withColumn("last", F.size("s") - 1)
    d = d.withColumn("again", F.expr(f"sort_array(transform(filter(s, (x, j) -> (j > 0 AND {same.format('greatest(j - 1, 0)')}) OR (j < last AND {same.format('least(j + 1, last)')})), x -> x & m))"))
    covered = "aggregate(again, named_struct('n', 0L, 'e', -1L), (a, x) -> named_struct('n', a.n + x + 2 - greatest(a.e, x - 1), 'e', x + 2), a -> a.n)"
    d = d.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)) != ""))
    return d.select(
        *keep,
        "n_words",
        F.length(F.translate("text", _BLANK, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _grams(docs: DataFrame) -> DataFrame:
    """Adds grams: the buckets of all units and pairs of units of the text."""
    d = docs.withColumn("u", F.regexp_extract_all("text", F.lit(_UNIT), F.lit(0)))
    one = f"transform(u, x -> cast(pmod(xxhash64(x), {BUCKETS}) AS int))"
    two = f"transform(u, (x, i) -> cast(pmod(xxhash64(x, get(u, i - 1)), {BUCKETS}) AS int))"
    return d.withColumn("grams", F.expr(f"concat({one}, {two})")).drop("u")


def _text(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def trusted_ids(labels: DataFrame, most: int = MOST_TARGETS) -> DataFrame:
    """doc_id of up to `most` documents labelled as good, chosen by the hash of the id."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def bucket_weights(docs: DataFrame, labels: DataFrame, most: int = MOST_TARGETS) -> list[float]:
    """log(target / raw) of each bucket, with one count added over all buckets to either."""
    ids = F.broadcast(trusted_ids(labels, most).withColumn("good", F.lit(1)))  # `most` rows at most
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text(docs).alias("text")).join(ids, "doc_id", "left")
    # explode() would infer a filter on the array, and Spark would push it, with the array's computation, below.
    rows = _grams(d).select("good", F.explode_outer("grams").alias("g"))
    got = rows.filter("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("raw"), F.count("good").alias("target")).collect()  # `BUCKETS` rows at most
    raw, target = [0.0] * BUCKETS, [0.0] * BUCKETS
    for g, a, b in got:
        raw[g], target[g] = float(a), float(b)
    if not sum(target):
        return [0.0] * BUCKETS
    n, m = sum(raw), sum(target)
    # The target is smoothed towards the raw multinomial, so a bucket that it lacks isn't judged by chance.
    floor = [(a + 1.0) / (n + BUCKETS) for a in raw]
    return [math.log((b + 20.0 * BUCKETS * f / 64) / (m + 20.0 * BUCKETS / 64)) - math.log(f) for b, f in zip(target, floor, strict=True)]


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MOST_TARGETS) -> DataFrame:
    """The rule columns, llr (per n-gram) and kept of every row of docs, beside its own columns but those of the same names.

    kept is false if base_failed, else whether llr >= threshold. A null text counts as empty
    (its own column stays null); an empty text has llr 0 and fails the base rules. Without
    documents labelled as good every llr is 0. Ids that labels repeats count once; repeated
    rows of docs count each time.
    """
    own = docs.columns
    clash = {c: f"_own_{i}" for i, c in enumerate(own)}
    d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in clash.items()], _text(docs).alias("text"))
    table = F.expr("from_json('" + json.dumps([round(x, 9) for x in bucket_weights(docs, labels, most)]) + "', 'array<double>')")
    d = rule_columns(d)
    d = _grams(d).withColumn("llr", F.when(F.size("grams") == 0, 0.0).otherwise(F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get(table, g)) / F.size("grams")))
    # A column that isn't deterministic keeps a filter on kept from being pushed, with all that it needs, to the scan.
    d = d.drop("grams", "text").withColumn("_row", F.monotonically_increasing_id())
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold) & (F.col("_row") >= 0))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    return d.select(*[F.col(n).alias(c) for c, n in clash.items() if c not in added], *added)
