"""DuckDB SQL for the operators that SQL can express, written apart from their code."""

from __future__ import annotations

import math

from .licenses import TEMPLATES, bigram_set

_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_FILLED = r"regexp_matches({0}, '[^\x20\x09-\x0D]')"

_COUNTS = f"""t AS (SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format("text")} AS w, list_filter(string_split(text, chr(10)), lambda x: {_FILLED.format("x")}) AS ls FROM t),
g AS (SELECT doc_id, u.i AS i, list_slice(w, u.i, u.i + 7) AS win FROM w, unnest(range(1, len(w) - 6)) AS u(i)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS r FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM d) GROUP BY 1),
s AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id))"""

_G = 1.002 / 0.998


def _lean(name: str, own: str, by: str, wider: str, on: str) -> str:
    """Sketch rows of ``own`` with those of ``wider`` added as 100 documents."""
    using = ", ".join(filter(None, (on, "m")))
    share = f"SELECT {using}, b, 100 * n / sum(n) OVER (PARTITION BY {using}) AS n FROM {wider}"
    return f"""{name} AS (SELECT {by}, m, b, sum(n) AS n FROM (SELECT {by}, m, b, CAST(n AS DOUBLE) AS n FROM {own}
 UNION ALL SELECT {by}, m, b, n FROM (SELECT DISTINCT {by}, m FROM {own}) JOIN ({share}) USING ({using})) GROUP BY {by}, m, b)"""


QUALITY_RULES = f"""WITH {_COUNTS},
e AS (SELECT lang, source, unnest(['sym', 'rep', 'dup', 'len', 'words', 'chars']) AS m, unnest([n_symbols / nullif(word_chars, 0), n_repeat_words / nullif(n_words, 0), n_dup_lines / nullif(n_words, 0), word_chars / nullif(n_words, 0),
 CAST(nullif(n_words, 0) AS DOUBLE), CAST(nullif(word_chars, 0) AS DOUBLE)]) AS x FROM s),
k AS (SELECT lang, source, m, CASE WHEN x > 0 THEN CAST(ceil(ln(x) / {math.log(_G)!r}) AS INTEGER) END AS b, count(*) AS n FROM e WHERE x IS NOT NULL GROUP BY ALL),
kl AS (SELECT lang, m, b, sum(n) AS n FROM k GROUP BY ALL), ka AS (SELECT m, b, sum(n) AS n FROM k GROUP BY ALL),
{_lean("wl", "kl", "lang", "ka", "")}, {_lean("w0", "k", "lang, source", "wl", "lang")},
q AS (SELECT lang, source, m, min(v) FILTER (round(upto, 6) >= round(n * 0.25, 6)) AS q1, min(v) FILTER (round(upto, 6) >= round(n * 0.75, 6)) AS q3 FROM (
 SELECT lang, source, m, coalesce(pow({_G!r}, b) * {2 / (_G + 1)!r}, 0) AS v, sum(n) OVER (PARTITION BY lang, source, m ORDER BY b NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY lang, source, m) AS n FROM w0) GROUP BY ALL),
p AS (SELECT lang, source, {", ".join(f"max({x}) FILTER (m = '{m}') AS {m}_{x}" for m, x in (("sym", "q1"), ("sym", "q3"), ("rep", "q1"), ("rep", "q3"), ("dup", "q1"), ("dup", "q3"), ("len", "q1"), ("len", "q3"), ("words", "q1"), ("chars", "q1")))} FROM q GROUP BY 1, 2),
h AS (SELECT lang, source, sym_q3 + 4 * greatest(sym_q3 - sym_q1, 8 / chars_q1) AS sym, rep_q3 + 4 * greatest(rep_q3 - rep_q1, 8 / words_q1) AS rep, dup_q3 + 4 * greatest(dup_q3 - dup_q1, 2 / words_q1) AS dup, len_q1, len_q3 FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(n_symbols / nullif(word_chars, 0) <= sym AND n_repeat_words / n_words <= rep AND n_dup_lines / n_words <= dup
 AND word_chars / n_words BETWEEN len_q1 - 4 * greatest(len_q3 - len_q1, 2.5 / sqrt(n_words)) AND len_q3 + 4 * greatest(len_q3 - len_q1, 2.5 / sqrt(n_words)), true) AS kept
FROM s LEFT JOIN h USING (lang, source)"""

LINE_DEDUP = f"""WITH l AS (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, pos, line, len({_WORDS.format("line")}) AS w FROM l),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM n WHERE w > 0),
p AS (SELECT a.doc_id, a.k AS i, b.k AS j FROM q a JOIN q b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 11 AND b.upto - a.upto + a.w >= 12),
r AS (SELECT doc_id, i, min(j) AS j FROM p GROUP BY doc_id, i UNION SELECT doc_id, max(i), j FROM p GROUP BY doc_id, j),
x AS (SELECT r.doc_id, i, j, string_agg(line, chr(10) ORDER BY k) AS run FROM r JOIN q ON q.doc_id = r.doc_id AND k BETWEEN i AND j GROUP BY ALL),
y AS (SELECT doc_id, i, j FROM (SELECT *, min(CAST(doc_id AS HUGEINT) * 1000000 + i) OVER (PARTITION BY run) AS first FROM x) WHERE CAST(doc_id AS HUGEINT) * 1000000 + i > first),
gone AS (SELECT DISTINCT y.doc_id, q.pos FROM y JOIN q ON q.doc_id = y.doc_id AND k BETWEEN i AND j),
left_ AS (SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text, count(g.pos) AS n_deleted FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY 1)
SELECT d.doc_id, left_.text, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(n_deleted, 0) AS n_deleted FROM documents d LEFT JOIN left_ USING (doc_id)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KNOWN = ", ".join(f"({_quoted(k)}, [{', '.join(map(_quoted, bigram_set(v)))}])" for k, v in TEMPLATES.items())

LICENSES = rf"""WITH k(name, grams) AS (VALUES {_KNOWN}),
s AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), string_split_regex(text, '\n[\x20\x09-\x0D]*\n'), [text]))) AS s FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, s, list_filter(string_split_regex(lower(s), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM s),
b AS (SELECT doc_id, s, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) BETWEEN 2 AND 200),
m AS (SELECT doc_id, name, 2.0 * len(list_intersect(b, grams)) / (len(b) + len(grams)) AS score FROM b, k),
f AS (SELECT * FROM m WHERE score >= 0.8), a AS (SELECT doc_id, count(*) AS n, max(score) AS score FROM f GROUP BY 1)
SELECT d.doc_id, (SELECT max(name) FROM f WHERE f.doc_id = d.doc_id AND f.score = a.score) AS license, round(a.score, 6) AS score, coalesce(n, 0) AS n_matches FROM documents d LEFT JOIN a USING (doc_id)"""

MIXING = rf"""WITH RECURSIVE d AS (SELECT doc_id, source, lang, text, length(coalesce(text, '')) AS n, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN n < 200 THEN 'brief' WHEN (n - length(replace(text, ' | ', ''))) * 10 > n THEN 'table' WHEN (n - length(translate(text, '#*$%&', ''))) * 10 > n THEN 'markup'
 WHEN regexp_matches(text, '[A-Za-z0-9._]@[A-Za-z0-9]') THEN 'contact' WHEN n > 4000 THEN 'long' ELSE 'prose' END AS topic FROM d),
c0 AS (SELECT source AS s, lang AS l, topic AS t, CAST(sum(n_tokens) AS DOUBLE) AS base FROM t GROUP BY ALL HAVING sum(n_tokens) > 0),
c1 AS (SELECT s, l, t, base / sum(base) OVER () AS base FROM c0),
ms AS (SELECT s, 1.5 * sum(base) AS u, sqrt(sum(base)) AS w FROM c1 GROUP BY 1), ts AS (SELECT s, least(u, w * max((1 - coalesce(b, 0)) / a) OVER ()) AS ts FROM (SELECT *, sum(u) OVER (ORDER BY u / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, sum(w) OVER (ORDER BY u / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM ms)),
ml AS (SELECT l, 1.5 * sum(base) AS u, sqrt(sum(base)) AS w FROM c1 GROUP BY 1), tl AS (SELECT l, least(u, w * max((1 - coalesce(b, 0)) / a) OVER ()) AS tl FROM (SELECT *, sum(u) OVER (ORDER BY u / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, sum(w) OVER (ORDER BY u / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM ml)),
mt AS (SELECT t, 1.5 * sum(base) AS u, sqrt(sum(base)) AS w FROM c1 GROUP BY 1), tt AS (SELECT t, least(u, w * max((1 - coalesce(b, 0)) / a) OVER ()) AS tt FROM (SELECT *, sum(u) OVER (ORDER BY u / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, sum(w) OVER (ORDER BY u / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM mt)),
c2 AS (SELECT c1.*, ts, tl, tt FROM c1 JOIN ts ON ts.s IS NOT DISTINCT FROM c1.s JOIN tl ON tl.l IS NOT DISTINCT FROM c1.l JOIN tt USING (t)),
rake AS (SELECT 0 AS it, s, l, t, base * 2 AS u, ts, tl, tt, base AS w FROM c2 UNION ALL
 SELECT it + 1, s, l, t, u, ts, tl, tt, w * max((tt - coalesce(b, 0)) / a) OVER (PARTITION BY t) FROM (SELECT *, sum(u) OVER (PARTITION BY t ORDER BY u / w, s, l, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, sum(w) OVER (PARTITION BY t ORDER BY u / w, s, l, t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM (
 SELECT it, s, l, t, u, ts, tl, tt, w * max((tl - coalesce(b, 0)) / a) OVER (PARTITION BY l) AS w FROM (SELECT *, sum(u) OVER (PARTITION BY l ORDER BY u / w, s, l, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, sum(w) OVER (PARTITION BY l ORDER BY u / w, s, l, t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM (
 SELECT it, s, l, t, u, ts, tl, tt, w * max((ts - coalesce(b, 0)) / a) OVER (PARTITION BY s) AS w FROM (SELECT *, sum(u) OVER (PARTITION BY s ORDER BY u / w, s, l, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, sum(w) OVER (PARTITION BY s ORDER BY u / w, s, l, t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM rake WHERE it < 400)))))),
p AS (SELECT s, l, t, least(1, w / u) AS probability FROM rake WHERE it = 400),
j AS (SELECT doc_id, source, lang, topic, n_tokens, CASE WHEN n_tokens > 0 THEN coalesce(probability, 0) ELSE 1 END AS probability FROM t LEFT JOIN p ON p.s IS NOT DISTINCT FROM t.source AND p.l IS NOT DISTINCT FROM t.lang AND p.t = t.topic)
SELECT doc_id, source, lang, topic, n_tokens, round(probability, 4) AS probability, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < probability AS kept FROM j"""


_CRC = """list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
 lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)"""

PREFIX_TRIE = f"""WITH t AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS b, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS g FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(g := g, b := b) ORDER BY turn NULLS FIRST, g) AS own FROM t GROUP BY 1),
c AS (SELECT conv_id, own, xor({_CRC}, 4294967295) % 9 AS h, conv_id - (conv_id % 5 + 5) % 5 AS base FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(p.own[:c.h], []), c.own[c.h + 1:]) AS s FROM c LEFT JOIN o p ON p.conv_id = c.base),
m AS (SELECT conv_id, len(s) AS n, u.d AS depth, sha256(array_to_string(list_transform(s[:u.d], lambda x: x.g), '')) AS k, CASE WHEN u.d > 0 THEN s[u.d].b ELSE 0 END AS b FROM r, unnest(range(len(s) + 1)) AS u(d)),
v AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(b) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
e AS (SELECT v.*, p.k AS pk FROM v LEFT JOIN m p ON p.conv_id = v.conv_id AND p.depth = v.depth - 1),
l AS (SELECT e.depth, e.k, e.saved, NOT EXISTS (SELECT 1 FROM e x WHERE x.pk = e.k AND x.depth = e.depth + 1) AS leaf, e.conv_id FROM e),
s AS (SELECT a.depth, a.k, sum(l.saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM l JOIN m a ON a.conv_id = l.conv_id AND a.depth <= l.depth GROUP BY 1, 2),
n AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS n_children FROM e WHERE depth > 0 GROUP BY 1, 2)
SELECT e.conv_id, CAST(e.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, e.n_convs, CAST(coalesce(n.n_children, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, e.ends_sha256
 FROM e JOIN s ON s.depth = e.depth AND s.k = e.k LEFT JOIN n ON n.depth = e.depth AND n.k = e.k LEFT JOIN v p ON p.k = e.pk AND p.depth = e.depth - 1"""

EXACT_DEDUP = """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
 FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

ORACLE_SQL = {
    "op3_mixing": MIXING,
    "op4_line_dedup": LINE_DEDUP,
    "op5_licenses": LICENSES,
    "op7_quality_rules": QUALITY_RULES,
    "op11_exact_dedup": EXACT_DEDUP,
    "op13_prefix_trie": PREFIX_TRIE,
}
