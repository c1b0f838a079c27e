"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import mixing

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {pattern})"


JACCARD = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_SPACE)} AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
x AS (SELECT r, unnest(g) AS h FROM s),
k AS (SELECT a.r AS p, b.r AS q, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT p, q FROM k JOIN s a ON a.r = p JOIN s b ON b.r = q WHERE 100 * c >= 90 * (len(a.g) + len(b.g) - c)),
u AS (SELECT p, q FROM e UNION ALL SELECT q, p FROM e),
reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, u.q FROM reach JOIN u ON u.p = reach.b)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT a, min(t.doc_id) AS c FROM reach JOIN s t ON t.r = b GROUP BY a) m ON m.a = s.r"""

DECONTAMINATE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_ALNUM)} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_words(_ALNUM)} AS w FROM benchmark),
n AS (SELECT item, w, least(13, len(w)) AS m FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, m, array_to_string(w[k:k + m - 1], ' ') AS g FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM n) q),
dw AS (SELECT r, m, k, array_to_string(w[k:k + m - 1], ' ') AS g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM n) z WHERE len(w) >= m) q),
h AS (SELECT r, k, dw.m, item FROM dw JOIN iw ON iw.m = dw.m AND iw.g = dw.g),
c AS (SELECT r, count(DISTINCT p) AS hit FROM (SELECT r, unnest(range(k, k + m)) AS p FROM h) q GROUP BY r),
t AS (SELECT r, count(*) AS items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) q GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""

_ESCAPED = r"(length({0}) + length({0}) - length(translate({0}, '\<[]', '')))"
CHAT = rf"""WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
b AS (SELECT *, lag(role, 1, '') OVER w AS before, row_number() OVER w AS k FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_ESCAPED.format('text')} + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 15 WHEN 'assistant' THEN 8 ELSE 17 + {_ESCAPED.format('role')} END) AS BIGINT) AS formatted_chars,
  bool_and((before, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) AS valid
FROM b GROUP BY conv_id"""


def _mix() -> str:
    steps, last = [], "w0"
    for k in range(mixing.ROUNDS):
        for m in mixing.MARGINS:
            name = f"w{k}_{m}"
            steps.append(f"{name} AS MATERIALIZED (SELECT q.source, q.lang, q.topic, q.t, q.w * g.want / sum(q.w) OVER (PARTITION BY q.{m}) AS w FROM {last} q JOIN want_{m} g ON g.name = q.{m})")
            last = name
    wants = ", ".join(f"share_{m} AS (SELECT {m} AS name, pow(sum(t) / (SELECT sum(t) FROM c), {mixing.POWERS[m]}) AS p FROM c GROUP BY {m}), want_{m} AS MATERIALIZED (SELECT name, p / (SELECT sum(p) FROM share_{m}) AS want FROM share_{m})" for m in mixing.MARGINS)
    return f"""WITH a AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CAST(len(regexp_extract_all(coalesce(text, ''), {_SPACE})) AS BIGINT) AS n_tokens, {_words(_ALNUM)} AS x FROM documents),
e AS MATERIALIZED (SELECT r, y, count(*) AS k FROM (SELECT r, unnest(x) AS y FROM a) q WHERE strlen(y) >= {mixing.LONG} GROUP BY r, y),
v AS MATERIALIZED (SELECT y, docs, row_number() OVER (ORDER BY docs DESC, y) AS k FROM (SELECT y, count(*) AS docs FROM e GROUP BY y) q
  WHERE docs >= {mixing.LEAST_DOCS} AND {mixing.RARE} * docs <= (SELECT count(*) FROM documents) QUALIFY count(*) OVER (ORDER BY docs DESC) <= {mixing.VOCABULARY}),
i AS MATERIALIZED (SELECT r, e.k, v.k AS word, docs FROM e JOIN v ON e.y = v.y),
b AS MATERIALIZED (SELECT word, topic FROM (SELECT i.word, s.word AS topic, row_number() OVER (PARTITION BY i.word ORDER BY count(*) / CAST(s.docs AS DOUBLE) DESC, s.word) AS z
  FROM i JOIN i s ON i.r = s.r AND s.word <= {mixing.TOPICS} GROUP BY i.word, s.word, s.docs) q WHERE z = 1),
f AS MATERIALIZED (SELECT r, topic FROM (SELECT r, topic, row_number() OVER (PARTITION BY r ORDER BY sum(i.k) DESC, topic) AS z FROM i JOIN b ON b.word = i.word GROUP BY r, topic) q WHERE z = 1),
d AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(v.y, '') AS topic, n_tokens FROM a LEFT JOIN f ON f.r = a.r LEFT JOIN v ON v.k = f.topic),
c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS t FROM d GROUP BY source, lang, topic HAVING sum(n_tokens) > 0),
{wants}, w0 AS (SELECT *, t / (SELECT sum(t) FROM c) AS w FROM c), {", ".join(steps)},
o AS (SELECT *, t / w AS ratio, sum(t) OVER z - t AS full_t, (SELECT sum(w) FROM {last}) - (sum(w) OVER z - w) AS rest FROM {last} WINDOW z AS (ORDER BY t / w, source, lang, topic)),
r AS (SELECT min((({mixing.FRACTION} * (SELECT sum(t) FROM c)) - full_t) / rest) AS rate FROM o WHERE (({mixing.FRACTION} * (SELECT sum(t) FROM c)) - full_t) / rest <= ratio AND ratio = (SELECT min(ratio) FROM o WHERE (({mixing.FRACTION} * (SELECT sum(t) FROM c)) - full_t) / rest <= ratio)),
j AS (SELECT d.*, coalesce(w, 0.0) AS weight, CASE WHEN w IS NULL THEN 1.0 ELSE least(1.0, (SELECT rate FROM r) * w / t) END AS p FROM d LEFT JOIN {last} q ON q.source = d.source AND q.lang = d.lang AND q.topic = d.topic)
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 9) AS weight, round(p, 9) AS probability,
  CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / pow(16.0, 13) < p AS sampled FROM j"""

_RUNS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')"
SPELLING = f"""WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS x FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS MATERIALIZED (SELECT id, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest({_RUNS}) AS run FROM documents) q WHERE length(run) >= 6 GROUP BY id, run),
bytes AS (SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS b FROM runs),
hashed AS (SELECT run, n, xor(list_reduce([4294967295] || b, lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed) q WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS MATERIALIZED (SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words) q),
near AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(z := -n, w := other)) AS best FROM near GROUP BY word),
out AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.z >= 5 * w.n THEN best.w END AS form, CASE WHEN -best.z >= 5 * w.n THEN -best.z END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
way AS (SELECT word, word AS last FROM out UNION ALL SELECT way.word, out.form FROM way JOIN out ON out.word = way.last WHERE out.form IS NOT NULL)
SELECT out.word, out.form, last AS root, out.n, CAST(out.n_near AS BIGINT) AS n_near, CAST(out.form_n AS BIGINT) AS form_n FROM out JOIN way ON way.word = out.word JOIN out e ON e.word = last AND e.form IS NULL"""


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    near = "SELECT q.r, q.part, min(struct_pack(d := list_sum(list_transform(list_zip(q.u, c.u), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := c.entry)) AS best FROM p q JOIN {0} c ON c.part = q.part GROUP BY q.r, q.part"
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(f'c{k}')})")
        steps.append(f"s{k} AS (SELECT part, e, i, sum(x) AS s, count(*) AS n FROM (SELECT p.part, best.e AS e, unnest(p.u) AS x, unnest(range(len(p.u))) AS i FROM p JOIN a{k} a ON a.r = p.r AND a.part = p.part) q GROUP BY part, e, i)")
        steps.append(f"m{k} AS (SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS u FROM s{k} GROUP BY part, e)")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.u, c.u) AS u FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.e = c.entry)")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS u FROM (SELECT r, v, unnest(range({parts})) AS part FROM v) q),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, u FROM p WHERE r <= {entries}), {", ".join(steps)},
f AS MATERIALIZED ({near.format(f"c{rounds}")}),
o AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM f GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(u, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN o ON o.r = v.r, h"""


ORACLES = {"op3_ngram_jaccard_join": JACCARD, "op5_chat_format": CHAT, "op6_mix_sources": _mix(), "op9_decontaminate": DECONTAMINATE, "op11_spelling_variants": SPELLING, "op12_vector_codes": _codes()}
