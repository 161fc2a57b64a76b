"""DuckDB SQL for the rows of those queries that SQL can express."""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {}

SQL["op2_decontaminate"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER.format('text')}, ''), '{BENCH_WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(coalesce({LOWER.format('text')}, ''), '{BENCH_WORD}') AS w FROM benchmark),
iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS size,
              array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS key
       FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS key
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, p, size, item FROM dw JOIN iw USING (size, key)),
words AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit
          FROM (SELECT doc_id, p, unnest(range(0, size)) AS k FROM (SELECT DISTINCT doc_id, p, size FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

SQL["op9_chat_snapshots"] = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
             sha256(string_agg(sha256(role) || sha256(text), '') OVER w) AS h
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
whole AS (SELECT place, h, min(conv_id) AS conv_id, count(*) AS n_equal FROM p WHERE place = n GROUP BY 1, 2),
kept AS (SELECT * FROM whole ANTI JOIN (SELECT place, h FROM p WHERE place < n) USING (place, h))
SELECT k.conv_id, k.place AS n_turns, n_equal,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY p.place) AS rendered
FROM kept k JOIN p ON p.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL"""

SQL["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
c AS (SELECT digest, min(page_id) AS first, count(*) AS k FROM d WHERE n >= 100 GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT d.*, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
      FROM d LEFT JOIN c USING (digest))
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, true AS intact FROM r"""

SQL["op7_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN
        [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
        ELSE [] END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b USING (g)
          WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
          WHERE 100 * k >= 80 * (len(x.s) + len(y.s) - k)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT walk.doc_id, sym.b FROM walk JOIN sym ON sym.a = walk.r)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.r AS component_id
FROM s JOIN (SELECT doc_id, min(r) AS r FROM walk GROUP BY 1) m USING (doc_id)"""


def _spans(kind: str, place: int, pattern: str, good: str) -> str:
    """List of {s, o, e, k} of the matches m of ``pattern`` in t for which ``good`` holds; places in code points."""
    quoted = pattern.replace("'", "''")
    found, gaps = f"regexp_extract_all(t, '{quoted}')", f"string_split_regex(t, '{quoted}')"
    at = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0)"
    return f"""(SELECT list_transform(list_filter(list_transform(range(1, len(f) + 1), lambda i: {{'s': {at}, 'm': f[i]}}),
        lambda x: {good.format(m='x.m')}), lambda x: {{'s': x.s::BIGINT, 'o': {place}, 'e': (x.s + length(x.m))::BIGINT, 'k': '{kind}'}})
        FROM (SELECT {found} AS f, {gaps} AS g))"""


_DIGITS = "regexp_replace({m}, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: [
    CAST(substr(reverse({_DIGITS}), j, 1) AS INTEGER), [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr(reverse({_DIGITS}), j, 1) AS INTEGER) + 1]
    ][(j - 1) % 2 + 1])) % 10 = 0"""
_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split({m}, '.'), lambda p: CAST(p AS HUGEINT))) <= 255"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
]
_SECRETS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
     r"""length(regexp_extract({m}, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 12"""),
    ("access", r"AKIA[A-Z0-9]+", "length({m}) >= 18"),
    ("hex", r"[0-9a-f]+", "length({m}) >= 16"),
]


def _span_sql(kinds: list, order: str, more: str = "") -> str:
    lists = ", ".join(f"{_spans(k, i, p, good)} AS {k}" for i, (k, p, good) in enumerate(kinds))
    every = " || ".join(k for k, _, _ in kinds)
    text = "array_to_string(list_transform({0}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    s AS (SELECT doc_id, {lists} FROM d), l AS (SELECT *, {order.format(every)} AS spans FROM s)
    SELECT doc_id, {', '.join(f'len({k})::BIGINT AS n_{k}' for k, _, _ in kinds)},
           sha256({text.format('spans')}) AS base_sha256, {text.format('spans')} AS spans FROM l"""


# The kinds that the methods add do not occur in the given tables; their rules are tested on fixtures.
SQL["op3_pii"] = _span_sql(_PII, "({0})")
SQL["op5_secret_scan"] = _span_sql(_SECRETS, "list_sort({0})")

# The text of the given pages stands in one article element, in which blocks are h1 and p.
SQL["op10_html_text"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|<footer)', 1) AS x FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(x, '</?(?:p|h1|br)>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)) AS x FROM a),
c AS (SELECT page_id, url, list_transform(x, lambda y: trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(y, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&lt;', '<'),
            '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS x FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(x, lambda y: y <> ''), ' ') AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d"""

RANK_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SQL["op12_ranked_search"] = f"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{RANK_TERM}')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(
        {LOWER.format("coalesce(text, '')")}, '{RANK_TERM}')) AS t FROM benchmark) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), s),
m AS (SELECT doc_id, 25 + (75 * n * docs) // words AS m FROM n, s),
f AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f WHERE score > 0) WHERE rank <= 10"""
