"""Plain re-statements of the operators' contracts, for comparison."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = SPACE.findall((text or "").translate(UP))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near(rows, k, num, den):
    """{(doc_id, n, component)} as a sorted list; rows: (doc_id, text)."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for i, s in enumerate(sets):
        seen = {}
        for x in s:
            for j in index.get(x, ()):
                seen[j] = seen.get(j, 0) + 1
            index.setdefault(x, []).append(i)
        for j, inter in seen.items():
            if den * inter >= num * (len(s) + len(sets[j]) - inter):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = d if least.get(r) is None else min(least[r], d)
    key = lambda x: tuple((v is None, v) for v in x)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=key)


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode()) if doc_id is not None else None


def lm_base(rows, fold=7, held_out=2):
    """[(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)]."""
    toks = [[*SPACE.findall((t or "").translate(UP)), None] for _, t in rows]
    held = [d is not None and crc(d) % fold == held_out for d, _ in rows]
    c = Counter(w for h, ws in zip(held, toks, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (d, _), h, ws in zip(rows, held, toks, strict=True)]


def lm_scores(rows, L, order=3, fold=7, held_out=2, deleted=3):
    """[(doc_id, held_out, n_tokens, score)]; L: the module, for its constants."""
    toks = [[None, None, *SPACE.findall((t or "").translate(UP)), None] for _, t in rows]
    role = [crc(d) % fold if d is not None else -1 for d, _ in rows]

    def counted(keep):
        one, two, three = Counter(), Counter(), Counter()
        for w, r in zip(toks, role, strict=True):
            if keep(r):
                for k in range(2, len(w)):
                    one[w[k]] += 1
                    two[w[k - 1], w[k], k == 2] += 1
                    three[w[k - 2], w[k - 1], w[k], min(k - 2, 2)] += 1
        # A pair that begins a text is the pair of an end and a word, as within no text.
        return one, two, three

    def token(counts, w, k):
        one, two, three = counts
        c2 = two[w[k - 1], w[k], k == 2]
        context = one[None] if k == 2 else two[w[k - 2], w[k - 1], k == 3]
        return one[w[k]], c2, one[w[k - 1]], three[w[k - 2], w[k - 1], w[k], min(k - 2, 2)], context

    bucket = lambda c: min(L.BUCKETS - 1, int(math.log2(c + 1)))
    level = lambda p: 0 if p <= 0 else int(min(max(round(-8 * math.log2(p)), 0), L.LEVELS - 2)) + 1
    value = lambda v: 0.0 if v == 0 else 2.0 ** (-(v - 1) / 8)
    every, rest = counted(lambda r: r != held_out), counted(lambda r: r not in (held_out, deleted))
    n_all, n_rest, types = sum(every[0].values()), sum(rest[0].values()), len(every[0])
    apart = [(w, k) for w, r in zip(toks, role, strict=True) if r == deleted for k in range(2, len(w))]

    cells = Counter()
    for w, k in apart:
        c1, c2, ch, _, _ = token(rest, w, k)
        cells[bucket(ch), level(c2 / max(ch, 1)), level(c1 / max(n_rest, 1))] += 1
    weights = {}
    for b in range(L.BUCKETS):
        own = [(value(p2), value(p1), n) for (x, p2, p1), n in cells.items() if x == b]
        if not own:
            continue
        x = [1 / 3] * 3
        for _ in range(50):
            got = [0.0] * 3
            for p2, p1, n in own:
                part = [x[0] / (types + 1), x[1] * p1, x[2] * p2]
                for i in range(3):
                    got[i] += n * part[i] / sum(part)
            x = [(g + 0.5) / (sum(got) + 1.5) for g in got]
        weights[b] = x
    mean = [sum(x[i] for x in weights.values()) / len(weights) for i in range(3)] if weights else [1 / 3] * 3

    def pairs(counts, n, w, k):
        c1, c2, ch, _, _ = token(counts, w, k)
        x = weights.get(bucket(ch), mean)
        return x[0] / (types + 1) + x[1] * c1 / max(n, 1) + x[2] * c2 / max(ch, 1)

    cells = Counter()
    for w, k in apart:
        _, _, _, c3, context = token(rest, w, k)
        cells[bucket(context), level(c3 / max(context, 1)), level(pairs(rest, n_rest, w, k))] += 1
    share = {}
    for b in range(1, L.BUCKETS):
        own = [(value(p3), value(p2), n) for (x, p3, p2), n in cells.items() if x == b]
        if own:
            m = 0.5
            for _ in range(50):
                got = sum(n * m * p3 / (m * p3 + (1 - m) * max(p2, 1e-300)) for p3, p2, n in own)
                m = (got + 0.5) / (sum(n for *_, n in own) + 1)
            share[b] = m
    other = sum(share.values()) / len(share) if share else 0.5
    out = []
    for (d, _), w, r in zip(rows, toks, role, strict=True):
        score = 0.0
        for k in range(2, len(w)):
            p = pairs(every, n_all, w, k)
            if order == 3:
                _, _, _, c3, context = token(every, w, k)
                m = share.get(bucket(context), other) if bucket(context) else 0.0
                p = m * c3 / max(context, 1) + (1 - m) * p
            score += math.log10(p)
        out.append((d, r == held_out, len(w) - 2, score))
    return out


def quality(text):
    t = text or ""
    w = SPACE.findall(t)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    rep = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    out = (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(rep))
    return (*out, len(w) < 50 or 100 * len(rep) > 50 * len(w))


def llr(rows, labels, Q):
    """[(doc_id, llr, kept)]. Q: the module, for its constants."""
    import regex
    import xxhash

    unit = regex.compile(r"[\p{L}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{N}]+")

    def buckets(text):
        u = unit.findall(text or "")
        one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in u]
        # Of several arguments, each is hashed with the hash before as the seed; one that is null leaves the seed.
        two = one[:1] + [xxhash.xxh64_intdigest(u[k - 1].encode(), one[k]) for k in range(1, len(u))]
        return [(h - (1 << 64) if h >> 63 else h) % Q.BUCKETS for h in one + two]

    good = {d for d, q, _ in labels if q == 1 and d is not None}
    raw, target = Counter(), Counter()
    grams = [buckets(t) for _, t in rows]
    for (d, _), g in zip(rows, grams, strict=True):
        raw.update(g)
        if d in good:
            target.update(g)
    n, m = sum(raw.values()), sum(target.values())
    weight = {}
    for b in raw:
        floor = (raw[b] + 1.0) / (n + Q.BUCKETS)
        weight[b] = math.log((target[b] + 20.0 * Q.BUCKETS * floor / 64) / (m + 20.0 * Q.BUCKETS / 64)) - math.log(floor)
    out = []
    for (d, t), g in zip(rows, grams, strict=True):
        x = sum(weight[b] for b in g) / len(g) if g else 0.0
        out.append((d, round(x, 6), not quality(t)[-1] and x >= Q.THRESHOLD))
    return out


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, window=13, share=20):
    win = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(UP))
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            win.setdefault(tuple(w[k : k + m]), set()).add("" if i is None else str(i))
    sizes = sorted({len(k) for k in win})
    out = []
    for d, t in rows:
        w = ALNUM.findall((t or "").translate(UP))
        hit, found = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                x = tuple(w[k : k + m])
                if x in win:
                    hit.update(range(k, k + m))
                    found |= win[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and share * len(hit) >= len(w)))
    return out


ALL = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-"


def _base(text):
    out = []
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")])
    patterns = [("assign", f"(?:{names})[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)", 8), ("access", "(AKIA[A-Z0-9]+)", 16), ("hex", "([0-9a-f]+)", 32)]
    for order, (kind, pattern, least) in enumerate(patterns):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return sorted(out)


def _candidates(text):
    """(begin, end) of runs of 20 or more, with padding that nothing follows."""
    k, out = 0, []
    while k < len(text):
        if text[k] not in ALL:
            k += 1
            continue
        e = k
        while e < len(text) and text[e] in ALL:
            e += 1
        p = e
        while p < len(text) and text[p] == "=":
            p += 1
        padded = p > e and (p == len(text) or text[p] not in ALL)
        if e - k >= 20:
            out.append((k, p if padded else e))
        k = e
    return out


def _evenness(run, order):
    body = run.rstrip("=")
    digits, low, up = ALL[:10], ALL[36:62], ALL[10:36]
    own = next(set(a) for a in (digits, digits + "abcdef", digits + "ABCDEF", "234567" + up, digits + low, ALL[:62], ALL) if set(body) <= set(a))
    place = {c: i for i, c in enumerate(c for c in order if c in own)}
    x, n, size = [place[c] for c in body], len(body), len(place)

    def chi2(v, df):  # the upper tail, by the series of the lower incomplete gamma function
        if v <= 0:
            return 1.0
        term = total = 1.0 / (df / 2)
        k = df / 2
        while term > total * 1e-17:
            k += 1
            term *= v / 2 / k
            total += term
        if v / 2 > 200:
            return None
        return max(0.0, 1 - total * math.exp(-v / 2 + df / 2 * math.log(v / 2) - math.lgamma(df / 2)))

    tail = lambda z: math.erfc(abs(z) / math.sqrt(2))
    freq = Counter(x)
    stat = sum((freq.get(k, 0) - n / size) ** 2 / (n / size) for k in range(size))
    df = max(1, round((size - 1) * n / (n - 1)))
    quarter, room = Counter(4 * k // size for k in x), Counter(4 * k // size for k in range(size))
    changes = sum((a * 2 >= size) != (b * 2 >= size) for a, b in zip(x, x[1:], strict=False))
    half = size // 2 / size
    odds = 2 * half * (1 - half)
    mid = (size - 1) / 2
    expect = (n - 1) * (n - 2) / 2 / size**2
    repeats = n - 1 - len(set(zip(x, x[1:], strict=False)))
    p = [
        chi2(stat * df / (size - 1), df),
        chi2(sum((quarter.get(q, 0) - n * room[q] / size) ** 2 / (n * room[q] / size) for q in range(4)), 3),
        tail(max(0.0, abs(changes - odds * (n - 1)) - 0.5) / math.sqrt(odds * (1 - odds) * (n - 1))),
        tail(sum((a - mid) * (b - mid) for a, b in zip(x, x[1:], strict=False)) / ((size**2 - 1) / 12) / math.sqrt(n - 1)),
        tail(max(0.0, repeats - expect) / math.sqrt(expect + 0.25)),
    ]
    if None in p or min(p) < 1e-12:
        return 0.0  # far below what can be found
    return chi2(-2 * sum(map(math.log, p)), 10) or 0.0


def secrets(rows, S):
    """Sorted (doc_id, n_assign, n_access, n_hex, base_sha256, spans). S: the module, for the strings drawn of a chain and for constants."""
    chain = Counter()
    for _, t in rows:
        joined = "".join(w for w in re.findall(r"[0-9A-Za-z+/_-]+", t or "") if len(w) < 20 and not any(c.isdigit() for c in w))
        chain.update(zip(joined, joined[1:], strict=False))
    counts = [0] * len(ALL) ** 2
    for (a, b), n in chain.items():
        counts[ALL.index(a) * len(ALL) + ALL.index(b)] += n
    # Texts meet in slices in no fixed order; what joins them is a handful of transitions.
    ordinary = S.Ordinary(np.array(counts))
    tails = ordinary.tails()
    of = {}
    for i, (_, t) in enumerate(rows):
        for a, b in _candidates(t or ""):
            p = _evenness(t[a:b], ordinary.order)
            of[i, a, b] = (max(k for k, c in enumerate(S.CLASSES) if b - a >= c), S.BINS - 1 if p <= 0 else min(S.BINS - 1, int(-math.log(p) * S.STEP)))
    out = []
    for i, (d, t) in enumerate(rows):
        base = _base(t or "")
        spans = [(a, o, k, b) for a, o, k, b in base]
        for a, b in _candidates(t or ""):
            size, at = of[i, a, b]
            every = [x for c, x in of.values() if c == size]
            # The step-up rule: found if some bin no better than this one passes.
            found = any(at <= worst < -math.log(S.UNEVEN) * S.STEP - 1 and tails[size][worst] * len(every) <= S.LEVEL * sum(x <= worst for x in every) for worst in range(S.BINS))
            if found and not any(x <= a and y >= b for x, _, _, y in base):
                spans.append((a, 3, "random", b))
        text = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(s))
        n = Counter(k for _, _, k, _ in base)
        out.append((d, n["assign"], n["access"], n["hex"], hashlib.sha256(text(base).encode()).hexdigest(), text(spans)))
    return sorted(out)


def kinds(clause, near):
    """The kind of each i and h of a clause's symbols, or None."""
    words = [c for c in clause if c != "q"]
    out, place = [], -1
    for k, c in enumerate(clause):
        if c == "q":
            continue
        place += 1
        if c not in "ih":
            continue
        around = words[max(0, place - near) : place] + words[place + 1 : place + 1 + near]
        target = "t" in around
        if c == "h" and not target:
            out.append(None)
        elif "n" in words[max(0, place - near) : place]:
            out.append("negated")
        elif "r" in clause[:k] or "q" in clause[:k]:
            out.append("reported")
        else:
            out.append("threat" if c == "h" else "targeted" if target else "plain")
    return out


def toxic_paths(text, patterns, T):
    """Weights summed by kind. patterns: pattern -> (weight, whole word)."""
    total = Counter()
    for clause in re.split(r"[.!?;,:|\n]", text.lower()):
        symbols, weights = "", []
        for w in re.findall(r"[a-zà-ÿ]+|[\"“«„]", clause):
            fits = [(len(p), x, "i") for p, (x, whole) in patterns.items() if (w == p if whole else w.startswith(p))]
            fits += [(len(w), 1.0, "h")] if w in T.THREATS and w not in patterns else []
            if fits:
                _, x, c = max(fits)
                weights.append(x)
            else:
                c = "q" if w in '"“«„' else "t" if w in T.TARGETS else "n" if w in T.NEGATIONS else "r" if w in T.REPORTS else "o"
            symbols += c
        for x, k in zip(weights, kinds(symbols, T.NEAR), strict=True):
            if k:
                total[k] += x
    return total


def topics(texts, M):
    """(topic, words) of each text."""
    words = [Counter(w for w in ALNUM.findall((t or "").translate(UP)) if len(w.encode()) >= M.LONG) for t in texts]
    docs = Counter(w for c in words for w in c)
    vocabulary = sorted((w for w, n in docs.items() if n >= M.LEAST_DOCS and n * M.RARE <= len(texts)), key=lambda w: (-docs[w], w.encode()))
    vocabulary = [w for w in vocabulary if sum(docs[x] >= docs[w] for x in vocabulary) <= M.VOCABULARY]
    seeds = vocabulary[: M.TOPICS]
    topic = {}
    for w in vocabulary:
        score = [sum(w in c and s in c for c in words) / docs[s] for s in seeds]
        if any(score):
            topic[w] = score.index(max(score))
    out = []
    for t, c in zip(texts, words, strict=True):
        n = Counter()
        for w, k in c.items():
            if w in topic:
                n[topic[w]] += k
        out.append((seeds[min(n, key=lambda k: (-n[k], k))] if n else "", len(SPACE.findall(t or ""))))
    return out
