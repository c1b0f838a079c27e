"""Spelling variants: words one edit apart, grouped below their commonest form.

Words are counted in Spark. Two words that differ by one edit share all that stands before the edit
and all that stands behind it, so words are dealt by what lies outside of an open part of them: first
by either half, and where a group is large, by halves of the open part again. A group is
searched by a positional q-gram index over the open parts: a word's postings of fitting length and
position are merged in a heap, the long ones are only probed, and words that share as many grams as
one edit leaves are verified. A pair is reported by the one group whose open part holds the first
code point in which the two differ. Forms are followed by pointer doubling.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import merge
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import batched, lower_ascii, saved

#: Code points of a gram.
Q = 2
#: A group of more words is dealt anew by halves of its open part, while that has two code points.
MOST = 4096


def counted(docs: DataFrame, least_length: int = 6, least_count: int = 5, typo_one_in: int = 199) -> DataFrame:
    """word, n: distinct runs of at least `least_length` code points that occur `least_count` times or more.

    Runs are maximal over A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. Where `typo_one_in` divides
    the crc32 of "doc_id:run", the code point at that crc32 modulo the run's length is deleted.
    """
    run, h, size = F.col("run"), F.col("h"), F.length("run")
    # A maximal run of fewer code points can't become a word.
    found = F.regexp_extract_all(lower_ascii(F.col("text").cast("string")), F.lit(rf"[a-zÀ-ÿ]{{{max(least_length, 1)},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    at = (h % size).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    words = runs.select(F.when(h % typo_one_in == 0, cut).otherwise(run).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _outside(before: Column, behind: Column) -> Column:
    """Names the group of words that share `before` first and `behind` last code points outside the open part."""
    # Text of a negative length is none, so a word of s or s + 1 code points keeps both parts apart.
    ends = F.when(behind > 0, F.substr("word", F.length("word") - behind + 1)).otherwise("")
    return F.xxhash64("s", before, behind, F.substr("word", F.lit(1), before), ends)


def _halves(level: DataFrame) -> DataFrame:
    """Each row for both halves of its open part: one is left open, the other joins what is shared."""
    half = F.expr("(s - before - behind) div 2").cast("int")
    open_left = F.struct(F.col("before").alias("before"), (F.col("s") - F.col("before") - half).cast("int").alias("behind"))
    open_right = F.struct((F.col("before") + half).alias("before"), F.col("behind").alias("behind"))
    out = level.select("word", "n", "s", F.explode(F.array(open_left, open_right)).alias("part")).select("word", "n", "s", "part.before", "part.behind")
    return out.withColumn("key", _outside(F.col("before"), F.col("behind")))


def dealt(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n, s, before, behind, key: the groups in which pairs of s and s, or s and s + 1 code points meet.

    Of each pair that one edit makes, exactly one group's open part holds the first difference. Groups have `most` words
    or fewer, but for those with one open code point.
    """
    size = F.length("word")
    level = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("s"), F.lit(0).alias("before"), F.lit(0).alias("behind")).filter("s > 0")
    done, first = None, True
    while True:
        level = _halves(level)
        # A group without a word of s code points, or with one word, has no pair.
        sizes = level.groupBy("key").agg(F.count("*").alias("words"), F.count_if(size == F.col("s")).alias("short")).filter("words > 1 AND short > 0")
        level = saved(level.join(sizes.select("key", "words"), "key"), "groups")
        large = (F.col("words") > most) & (F.col("s") - F.col("before") - F.col("behind") > 1)
        kept = level.filter(~large).drop("words")
        done = kept if first else done.unionByName(kept)
        first, level = False, level.filter(large).drop("words")
        if level.isEmpty():
            return done


def _edit_at(a: str, b: str) -> int | None:
    """The first place where a differs from b, if b is a with one code point replaced or, being longer, inserted; else None."""
    at = len(commonprefix((a, b)))
    return at if a != b and a[at + (len(a) == len(b)) :] == b[at + 1 :] else None


def _shared_by(lists: list[list[int]], least: int) -> list[int]:
    """Ids in `least` of the sorted lists at least: the shortest are merged in a heap, the `least - 1` longest are probed."""
    lists = sorted(filter(None, lists), key=len)
    short, long = lists[: len(lists) - least + 1], lists[len(lists) - least + 1 :]
    out = []
    for i, same in groupby(merge(*short)):
        n = len(list(same))
        for k, ids in enumerate(long):
            if n >= least or n + len(long) - k < least:
                break
            at = bisect_left(ids, i)
            n += at < len(ids) and ids[at] == i
        if n >= least:
            out.append(i)
    return out


def _pairs(words: list[str], s: int, before: int, behind: int):
    """Index pairs (short one first) of a group's words one edit apart, first differing inside the open part."""
    grams, post = [], {}
    for i, w in enumerate(words):
        middle = "\0" * (Q - 1) + w[before : len(w) - behind] + "\1" * (Q - 1)
        grams.append([middle[k : k + Q] for k in range(len(middle) - Q + 1)])
        for k, g in enumerate(grams[i]):
            post.setdefault((len(w), k, g), []).append(i)
    short = [i for i, w in enumerate(words) if len(w) == s]
    end = s - behind if behind else s + 1
    for i in short:
        # A replaced code point touches Q grams of either word, an inserted one Q - 1 of the shorter.
        least = len(grams[i]) - Q
        if least > 0:
            same = _shared_by([p[bisect_left(p, i + 1) :] for k, g in enumerate(grams[i]) for p in [post[s, k, g]]], least)
        else:
            same = short[bisect_left(short, i + 1) :]
        longer = [list(merge(post.get((s + 1, k, g), ()), post.get((s + 1, k + 1, g), ()))) for k, g in enumerate(grams[i])]
        for j in (*same, *_shared_by(longer, len(grams[i]) - Q + 1)):
            at = _edit_at(words[i], words[j])
            if at is not None and before <= at < end:
                yield i, j


_PAIRS = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])


def _search(batches):
    """Pairs of every group of rows, which come sorted by group; no more than a group is held."""
    key, rows, out = None, {}, [[], [], [], []]

    def found():
        words = sorted(rows)
        for i, j in _pairs(words, *key[1:]):
            for column, x in zip(out, (words[i], rows[words[i]], words[j], rows[words[j]]), strict=True):
                column.append(x)

    for batch in batches:
        for *now, word, n in zip(*(batch.column(c).to_pylist() for c in ("key", "s", "before", "behind", "word", "n")), strict=True):
            if now != key:
                if len(rows) > 1:
                    found()
                    if len(out[0]) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, _PAIRS, strict=True)], schema=_PAIRS)
                        out = [[], [], [], []]
                key, rows = now, {}
            rows[word] = n
    if len(rows) > 1:
        found()
    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, _PAIRS, strict=True)], schema=_PAIRS)


def one_edit_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """a, a_n, b, b_n: each pair of distinct words (word, n) that one inserted, deleted or replaced code point parts, once; b isn't the shorter."""
    groups = batched(dealt(words, most)).repartition("key").sortWithinPartitions("key", "s", "before", "behind")
    return groups.mapInArrow(_search, "a string, a_n long, b string, b_n long")


def _roots(links: DataFrame) -> DataFrame:
    """word, root: where following (word, form) from each word ends. Forms are commoner than words, so no circle exists."""
    now = saved(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = saved(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, typo_one_in: int = 199, times: int = 5, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of `counted`.

    form is the near word (one edit apart) of largest n, of equal ones the first in code-point order, where its n is
    `times` the word's or more; else null, with form_n. root is where forms lead (the word itself without one), n_near the number of
    near words. A null text has no words; a null doc_id counts as empty text before the ':'. Repeated rows count
    each time. A word of any length is compared with all of its length, or one more. An empty table, or one without
    words, gives an empty result; other columns are ignored.
    """
    words = saved(counted(docs, least_length, least_count, typo_one_in), "words")
    pairs = saved(one_edit_pairs(words, most), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = words.join(best, "word", "left").withColumn("taken", -F.col("best.less") >= times * F.col("n"))
    out = out.select("word", F.when(F.col("taken"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("taken"), -F.col("best.less")).alias("form_n"))
    out = saved(out, "variants")
    roots = _roots(out.filter("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
