"""URL verdicts, chat formatting, and the pipeline."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cablewright.llm import chat, urls


def _rule(host, path):
    best = None
    for v, r in urls.RULES:
        d, _, rest = r.partition("/")
        if (host == d or host.endswith("." + d)) and path.startswith("/" + rest) and (best is None or len(r) > len(best[1])):
            best = (v, r)
    return best


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), re.match(r"[^?#]*", rest[len(host) :])[0]


PAGES = [
    (1, "http://a.Example.NET/en/1?x=http://b/", '<a href="https://good.io/x">'),
    (2, "http://a.example.net/fr/1", None),
    (3, "https://good.io/y", '<a href="//far.io/"> <a href=/local>'),
    (4, "https://far.io", ""),
    (5, "http://b.example.com/de/1", ""),
    (6, "https://links-to-bad.io/", "<a href='http://b.example.com/x'>"),
    (7, "http://b.example.com/fr/", ""),
    (8, "http://x.org/fr/q", '<img src="http://good.io/i.png">'),
    (9, None, None),
    (10, "no scheme", '<a href="http://good.io">'),
    (11, "http://net/", ""),
    (12, "http://net", ""),
    (13, "http://evilnet/", ""),
    (14, "x://\n#", ""),
    (14, "x://\n#", ""),
]


def _ranks(rounds=12, alpha=0.85):
    """The same propagation over dictionaries."""
    w = {}
    for _, u, html in PAGES:
        src = _split(u)[0]
        for m in re.finditer(urls._LINK, html or ""):
            if src and m[1].lower() != src:
                w[src, m[1].lower()] = w.get((src, m[1].lower()), 0) + 1
    out = {}
    for kind, edges, verdict in (("trust", w, "allow"), ("distrust", {(b, a): n for (a, b), n in w.items()}, "block")):
        seeds = {}
        for _, u, _ in PAGES:
            h, p = _split(u)
            if (r := _rule(h, p)) and r[0] == verdict:
                seeds[h] = seeds.get(h, 0) + 1
        total = sum(seeds.values())
        s = {h: n / total for h, n in seeds.items()}
        rank = dict(s)
        for _ in range(rounds):
            moved = {}
            for (a, b), n in edges.items():
                moved[b] = moved.get(b, 0) + rank.get(a, 0) * n / sum(k for (x, _), k in edges.items() if x == a)
            kept = sum(moved.values())
            rank = {h: alpha * moved.get(h, 0) + s.get(h, 0) * (1 - alpha * kept) for h in {*moved, *s}}
        out[kind] = rank
    return out


def test_urls(spark):
    d = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = urls.url_verdicts(d).collect()
    ranks = _ranks()
    assert len(got) == len(PAGES)
    by = {r.page_id: r for r in got}
    for i, u, _ in PAGES:
        h, p = _split(u)
        rule = _rule(h, p)
        t, bad = ranks["trust"].get(h, 0), ranks["distrust"].get(h, 0)
        want = rule[0] if rule else "block" if bad > t + 1e-9 else "allow"
        assert (by[i].host, by[i].path, by[i].rule, by[i].verdict) == (h, p, rule and rule[1], want), u
        assert abs(by[i].trust - (t if h else 0)) < 1e-9 and abs(by[i].distrust - (bad if h else 0)) < 1e-9
    assert by[6].verdict == "block" and by[4].verdict == "allow"
    assert urls.url_verdicts(d.limit(0)).collect() == []


def test_long_pages_and_turns(spark):
    """A page of a million characters with thousands of links, and a turn as long."""
    links = "".join(f'<a href="http://h{k % 50}.io/{k}">' for k in range(20_000)) + "x" * 1_000_000
    d = spark.createDataFrame([(1, "http://big.io/", links), (2, "http://h7.io/" + "p" * 100_000 + "?q", ""), (3, "http://a.net/", '<a href="http://big.io/">')], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.url_verdicts(d).collect()}
    assert got[2].path == "/" + "p" * 100_000 and got[3].verdict == "block" and len(got) == 3
    text = "[INST] \\ </s>" * 100_000
    talk = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_chat(talk)).first()
    assert r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_url_verdicts_do_not_depend_on_table_size(spark):
    """5000 hosts link to one blocked page, alone and beside 200,000 blocked pages of another host."""
    few = spark.range(5000).selectExpr("id AS page_id", "concat('http://r', id, '.io/') AS url", "'<a href=http://small.net/>' AS html").unionByName(spark.sql("SELECT -1L AS page_id, 'http://small.net/' AS url, '' AS html"))
    many = few.unionByName(spark.range(10**6, 10**6 + 200_000).selectExpr("id AS page_id", "'http://big.net/' AS url", "'' AS html"))
    for pages in (few, many):
        out = urls.url_verdicts(pages).filter("page_id < 5000")
        assert out.filter("verdict = 'block'").count() == 5001


TALK = [
    (1, 0, "system", "s"), (1, 1, "user", "u [INST] \\ </s>"), (1, 2, "assistant", "a\nb"), (1, 3, "user", "q"), (1, 4, "assistant", ""),
    (2, 0, "assistant", "first"), (2, 1, "tool", "<x>]"), (2, 2, None, None), (2, 2, "user", "tie"),
    (3, 5, "user", None), (None, 0, "user", "lost"), (4, None, "user", "\\l\\b"), (4, 0, "assistant", "é🤦"),
]


def test_chat(spark):
    d = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(7))
    out = {r.conv_id: r for r in chat.read_back(chat.format_chat(d)).collect()}
    for conv in {t[0] for t in TALK}:
        rows = sorted((t for t in TALK if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows)
        learned = "".join(t or "" for _, _, r, t in rows if r == "assistant")
        got = out[conv]
        assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert out[1].valid and not out[2].valid and out[3].valid and out[4].valid
    text = "".join(s.text for r in chat.format_chat(d).filter("conv_id = 1").orderBy("position").collect() for s in r.segments)
    assert text == "[SYS] s [/SYS]\n[INST] u \\bINST\\e \\\\ \\l/s> [/INST]<s>a\nb</s>\n[INST] q [/INST]<s></s>\n"
    assert chat.read_back(chat.format_chat(d.limit(0))).collect() == []


@pytest.mark.parametrize("text", ["", "\\", "\\\\l", "<s>[INST]]\\b", "[/ROLE]\n", "é\n\r"])
def test_escape(text):
    t = chat.Template()
    assert t.unescape(t.escape(text)) == text
    for role in ("system", "user", "assistant", "x] [INST] ", ""):
        assert t.parse("".join(s for s, _ in t.segments(role, text))) == (role, text)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if k < len(P.STAGES) - 1:
            assert after.columns == columns and 0 < after.count() <= docs.count()
            docs = after
    assert after.count() == docs.count() == P.run(spark, sf).count()


def test_stages_take_any_table(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns, and no rows, through every stage."""
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").limit(40)
    odd = [(None, None, None, None), (None, "no id here", "en", "a"), (7, "", "", ""), (7, "  \n", None, "b"), (10**9, " ".join(f"w{k}" for k in range(200_000)), "en", "a")]
    added = ["kept", "own", "n_words", "w", "topic", "weight", "sid", "base", "n_tokens", "llr", "value"]
    d = plain.unionByName(plain.limit(3)).unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string"))
    d = d.select("*", *[F.lit(c).alias(c) for c in added]).repartition(3)
    d.write.parquet(f"{tmp_path}/d")
    for table in (spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/d").limit(0)):
        n = table.count()
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, table, sf)
            rows = out.collect()
            assert out.columns == table.columns and len(rows) <= n, name
            assert all(r.value == "value" for r in rows), name
            if name == "ngram_jaccard_join" and n:
                assert sum(r.doc_id is None for r in rows) == 2 and any(r.doc_id == 10**9 for r in rows)
            if name == "decontamination" and n:
                assert any(r.doc_id == 10**9 for r in rows) and sum(r.doc_id is None for r in rows) == 2
        out = P.STAGES[-1][1](spark, table, sf)
        assert out.count() == n


def test_pipeline_keeps_distinct_texts_under_one_id(spark):
    import corpus_pipeline as P

    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(3, a), (8, a + " tail"), (8, b), (9, c), (9, c), (9, a), (None, a), (None, None), (10, b), (11, "alone here")]
    d = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, own string").repartition(3)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    got = sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, d, "").collect()), key=key)
    assert got == sorted([(3, a), (8, b), (9, c), (11, "alone here"), (None, a), (None, None)], key=key)
    once = d.dropDuplicates(["doc_id"])
    assert P.near_duplicates(spark, once, "").columns == d.columns


def test_rows_without_some_ids(spark, monkeypatch):
    from cablewright.llm import near

    rows = [(k, f"t{k}") for k in range(-50, 200)] + [(None, "lost"), (7, "again"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = list(range(-20, 60, 3))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = sorted((r for r in rows if r[0] is None or r[0] not in gone), key=key)
    ids = spark.createDataFrame([(k,) for k in [*gone, gone[0]]], "doc_id long")
    for most in (1 << 28, 512):  # a filter that stops other rows, too
        monkeypatch.setattr(near, "FILTER_MOST", most)
        monkeypatch.setattr(near, "FILTER_LEAST", min(most, 1 << 16))
        assert sorted(map(tuple, near.without_ids(d, ids).collect()), key=key) == want
    assert near.without_ids(d, ids.limit(0)).count() == len(rows)
