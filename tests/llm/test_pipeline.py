"""The pipeline's result against its five stages restated over lists and dictionaries, one after another."""

import hashlib
import zlib
from collections import defaultdict

import brute
import numpy as np

from cablewright.llm import mixing, quality, tokenfile


def _mixed(rows):
    """The documents (id, text, source, lang) that mixing keeps: topics, raking by cells, and the hash of each id."""
    found = brute.topics([t for _, t, _, _ in rows], mixing)
    cell = [(s or "", lang or "", topic) for (_, _, s, lang), (topic, _) in zip(rows, found, strict=True)]
    tokens = defaultdict(float)
    for c, (_, n) in zip(cell, found, strict=True):
        tokens[c] += n
    tokens = {c: n for c, n in tokens.items() if n}
    total = sum(tokens.values())
    want = []
    for k, m in enumerate(mixing.MARGINS):
        share = defaultdict(float)
        for c, n in tokens.items():
            share[c[k]] += n / total
        raised = {x: p ** mixing.POWERS[m] for x, p in share.items()}
        want.append({x: p / sum(raised.values()) for x, p in raised.items()})
    w = {c: n / total for c, n in tokens.items()}
    for _ in range(mixing.ROUNDS):
        for k, to in enumerate(want):
            have = defaultdict(float)
            for c, x in w.items():
                have[c[k]] += x
            w = {c: x * to[c[k]] / have[c[k]] for c, x in w.items()}
    # The rate by halving: cells give no more than they have.
    low, high = 0.0, max(tokens[c] / w[c] for c in w)
    for _ in range(200):
        rate = (low + high) / 2
        low, high = (rate, high) if sum(min(tokens[c], rate * w[c]) for c in w) < mixing.FRACTION * total else (low, rate)
    share = lambda d: int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:13], 16) / 16**13
    return [r for r, c in zip(rows, cell, strict=True) if c not in w or share(r[0]) < min(1.0, high * w[c] / tokens[c])]


def test_the_whole_pipeline_against_brute_force(spark):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in read("documents").collect()]
    assert len({d for d, *_ in rows}) == len(rows)
    labels = [(r.doc_id, r.quality, r.toxic) for r in read("labels").collect()]
    kept = {d for d, _, keep in brute.llr([r[:2] for r in rows], labels, quality) if keep}
    rows = [r for r in rows if r[0] in kept]
    counts = [len(rows)]
    alone = {d for d, _, c in brute.near([r[:2] for r in rows], P.SHINGLE, P.NUM, P.DEN) if d == c}
    rows = [r for r in rows if r[0] in alone]
    counts.append(len(rows))
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    foul = {x[0] for x in brute.contamination([r[:2] for r in rows], items) if x[-1]}
    rows = [r for r in rows if r[0] not in foul]
    counts.append(len(rows))
    rows = _mixed(rows)
    assert counts[0] > counts[1] > counts[2] > len(rows) > 20
    model, want, start = Tokenizer.from_file(tokenfile.default_tokenizer()), [], 0
    for d, t, _, _ in sorted(rows):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, tokenfile.END]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in P.run(spark, sf).collect()]
    assert sorted(got) == want
