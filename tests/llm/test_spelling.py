"""Spelling variants against brute force over all pairs, with nulls, repeats, long runs and clashing columns."""

import random
import re
import zlib
from collections import Counter

import pytest

from cablewright.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, length, count, one_in, times):
    seen = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= length:
                seen[w] += 1
    words = {w: n for w, n in seen.items() if n >= count}
    out, form = {}, {}
    for w, n in words.items():
        near = sorted((x for x in words if _near(w, x)), key=lambda x: (-words[x], x))
        form[w] = near[0] if near and words[near[0]] >= times * n else None
        out[w] = (n, len(near))
    root = {}
    for w in words:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return sorted((w, form[w] or "", root[w], n, k, words[form[w]] if form[w] else -1) for w, (n, k) in out.items())


def _rows():
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        words = ["".join(rng.choice("abÉé") for _ in range(rng.choice((2, 3, 4, 5, 6, 7, 9)))) for _ in range(rng.randrange(60))]
        texts.append(rng.choice((" ", "-", "\n", "1")).join(w.upper() if rng.random() < 0.2 else w for w in words))
    long = "xy" * 4000
    texts += [f"{long} {long} {long}z", f"{long}z {long[1:]} {long}", None, "", " \t", "×÷ÿ " * 9, "Ā abcdef ābcdef", texts[0], "aaaa aaaaa aaaaaa " * 30]
    return [*enumerate(texts), (None, "no id here"), (None, None), (0, texts[0]), (0, texts[0])]


@pytest.mark.parametrize("length,count,one_in,times,most", [(3, 2, 7, 2, 4096), (1, 1, 3, 1.5, 5), (6, 2, 199, 5, 2)])
def test_against_all_pairs(spark, length, count, one_in, times, most):
    rows = _rows()
    d = spark.createDataFrame([(i, t, "w", 1, "f", "r", 2) for i, t in rows], "doc_id long, text string, word string, n long, form string, root string, s int").repartition(3)
    got = spelling.spelling_variants(d, length, count, one_in, times, most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or -1) for r in got.collect()) == brute(rows, length, count, one_in, times)


def test_forms_lead_on(spark):
    rows = [(1, "abcdefg " * 200 + "abcdef " * 40 + "abcde " * 8 + "abcdx " * 1)]
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), 5, 1, 10**9).collect()
    assert {r.word: (r.form, r.root) for r in got} == {"abcdefg": (None, "abcdefg"), "abcdef": ("abcdefg", "abcdefg"), "abcde": ("abcdef", "abcdefg"), "abcdx": ("abcde", "abcdefg")}


def test_large_groups_are_dealt_anew(spark):
    words = [("same" + a + b + "tail", 5) for a in "abcdefgh" for b in "abcdefgh"]
    d = spark.createDataFrame(words, "word string, n long")
    groups = spelling.dealt(d, 12)
    assert groups.groupBy("key").count().agg({"count": "max"}).first()[0] <= 12
    pairs = {tuple(sorted((r.a, r.b))) for r in spelling.one_edit_pairs(d, 12).collect()}
    assert pairs == {(x, y) for x, _ in words for y, _ in words if x < y and _near(x, y)}


def test_no_rows(spark):
    for rows in ([], [(1, None)], [(1, "short words only")]):
        d = spark.createDataFrame(rows, "doc_id long, text string")
        assert spelling.spelling_variants(d).collect() == []
