"""DuckDB SQL for the queries whose whole result SQL can express."""

from __future__ import annotations

from isopleth.llm import chat, mixture, secrets

#: White space between words, as in :data:`isopleth.llm.text.SPACE`.
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chat_formatting(odd: str) -> str:
    open_, close = _quoted(chat.OPEN), _quoted(chat.CLOSE)
    esc = lambda c: rf"replace(replace(replace({c}, '\', '\\'), {close}, '<\/turn>'), {open_}, '#\## ')"
    unesc = lambda c: rf"replace(replace(replace({c}, '#\## ', {open_}), '<\/turn>', {close}), '\\', '\')"
    marks = len(chat.OPEN + chat.SEP + chat.CLOSE + chat.END)
    return rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_quoted(odd)} UNION ALL SELECT -7, 1, 'assistant', {_quoted(odd)}),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    contains(text, {close}) OR contains(text, {open_}) OR {unesc('text')} <> text AS conflict FROM t),
f AS (SELECT *, min(CASE WHEN conflict THEN i END) OVER (PARTITION BY conv_id) AS first FROM n),
e AS (SELECT *, CASE WHEN i >= first THEN {esc('text')} ELSE text END AS body,
    replace({esc('role')}, ': ', ':\ ') AS head FROM f)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({marks} + length(head) + length(body)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def secret_scans() -> str:
    parts = []
    for number, rule in enumerate(secrets.BASE + secrets.MORE):
        pattern = _quoted(rule.pattern)
        parts.append(f"""
SELECT doc_id, {number} AS kind, {_quoted(rule.kind)} AS name, s AS start, s + length(m[i]) AS stop FROM (
  SELECT doc_id, m, g, i, CAST(list_sum([length(x) FOR x IN p[1:i]])
      + coalesce(list_sum([length(x) FOR x IN m[1:i-1]]), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, {pattern}, 0) AS m, regexp_extract_all(text, {pattern}, {rule.group}) AS g,
      string_split_regex(text, {pattern}) AS p
    FROM documents WHERE regexp_matches(text, {pattern}))))
WHERE length(g[i]) >= {rule.least}""")
    spans = " UNION ALL ".join(parts)
    said = "name || ':' || start || ':' || stop"
    n_base = len(secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.BASE))
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH s AS ({spans}),
d AS (SELECT doc_id, {counts},
    string_agg({said}, ',' ORDER BY start, kind) FILTER (kind < {n_base}) AS base,
    string_agg({said}, ',' ORDER BY start, kind) AS spans FROM s GROUP BY doc_id)
SELECT documents.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN d USING (doc_id)"""


def source_mixing(weights: dict, max_epochs: int, seed: int) -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {_quoted(k)} THEN CAST({float(v)} AS DOUBLE)" for k, v in weights[level].items())
        return f"CASE {level} {cases} ELSE CAST(1.0 AS DOUBLE) END" if cases else "CAST(1.0 AS DOUBLE)"

    items = [f"""
d AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' ELSE 'curated' END AS domain, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source, lang AS l, source AS s, concat_ws('|', doc_id, md5(coalesce(text, ''))) AS k,
    len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS n FROM documents)""", """
leaves AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY ALL)"""]
    levels = [x[1:] for x in mixture.LEVELS]
    for depth, level in enumerate(levels):
        parents = levels[:depth]
        by = ", ".join(parents)
        part = f"PARTITION BY {by}" if parents else ""
        budget = "(SELECT sum(tokens) FROM leaves)" if not parents else f"(SELECT given FROM g{depth - 1} WHERE ({by}) = ({', '.join('c.' + p for p in parents)}))"
        group = ", ".join([*parents, level])
        items.append(f"""
c{depth} AS (SELECT {group}, CAST(sum(tokens) * {max_epochs} AS BIGINT) AS cap FROM leaves WHERE tokens > 0 GROUP BY {group})""")
        items.append(f"""
b{depth} AS (SELECT *, {weight(level)} AS w, CAST({budget} AS BIGINT) AS budget FROM c{depth} AS c)""")
        items.append(f"""
f{depth} AS (SELECT *, CASE WHEN w > 0 THEN cap / w ELSE CAST('inf' AS DOUBLE) END AS fill FROM b{depth})""")
        items.append(f"""
l{depth} AS (SELECT *, CAST(budget - coalesce(sum(cap) OVER ({part} ORDER BY fill, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / nullif(sum(w) OVER ({part} ORDER BY fill, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM f{depth})""")
        items.append(f"""
g{depth} AS (SELECT {group}, greatest(0, coalesce(least(cap, CAST(floor(max(level) OVER ({part}) * w + 1e-6) AS BIGINT)), 0)) AS given FROM l{depth})""")
    items.append("""
plan AS (SELECT *, given // tokens AS whole, given % tokens AS part FROM leaves JOIN g2 USING (domain, lang, source))""")
    items.append(f"""
o AS (SELECT *, md5(concat_ws('|', '{seed}', whole, k)) AS ord FROM d JOIN plan USING (domain, lang, source))""")
    items.append("""
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)""")
    items.append("""
taken AS (
  SELECT *, unnest(range(0, whole)) AS epoch, n AS used FROM r
  UNION ALL SELECT *, whole AS epoch, least(n, part - before) AS used FROM r WHERE part > before)""")
    return "WITH " + ",".join(items) + """
SELECT doc_id, domain, l AS lang, s AS source, CAST(epoch AS BIGINT) AS epoch, CAST(n AS BIGINT) AS n_tokens, CAST(used AS BIGINT) AS used FROM taken"""


def ngram_jaccard(width: int, percent: int) -> str:
    grams = "||' '||".join(f"w[i+{k}]" if k else "w[i]" for k in range(width))
    return f"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= {width} THEN list_distinct([{grams} FOR i IN range(1, len(w) - {width} + 2)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM t),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x AS a JOIN x AS b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) USING (doc_id)"""


def warc_records() -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    five = lambda j: f"CAST('0x' || substr(h, {5 * j + 1}, 5) AS BIGINT)"
    chars = " || ".join(f"substr({letters}, CAST(({five(j)} >> {s}) & 31 AS BIGINT) + 1, 1)" for j in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {chars} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM m"""


def sharding(shards: int, slack: str) -> str:
    steps = ", ".join(str(i) for i in range(256))
    half = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = f"[{steps}]"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: {half})"
    hashed = lambda c: f"CAST('0x' || substr(md5({c}), 1, 15) AS BIGINT)"
    return f"""
WITH crc AS (SELECT list_transform({table}, lambda c: CAST(c AS BIGINT)) AS t),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h,
    {hashed("md5(coalesce(text, ''))")} AS k, {hashed("coalesce(CAST(doc_id AS VARCHAR), '')")} AS s FROM documents),
z AS (SELECT doc_id, size, k, s, xor(list_reduce(list_prepend(4294967295,
    [CAST('0x' || h[2*i-1:2*i] AS BIGINT) FOR i IN range(1, size - 7)]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc),
a AS (SELECT *, coalesce(sum(size) OVER (ORDER BY k, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
    row_number() OVER (ORDER BY k, s) AS i, sum(size) OVER () AS total FROM z),
g AS (SELECT *, 2 * min(a) OVER w + sum(size) OVER w AS mid, count(*) OVER w > 1 AND sum(size) OVER w * {shards} <= {slack} * total AS whole
  FROM a WINDOW w AS (PARTITION BY k)),
p AS (SELECT *, CAST(least({shards - 1}, CASE WHEN whole THEN mid ELSE 2 * a + size END * {shards} // (2 * total)) AS INTEGER) AS shard FROM g)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY i) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""


def periodic_runs(times: int = 4, least: int = 6) -> str:
    """Every period of every text tried: equal stretches between a text and itself moved by the period."""
    bits = "flatten([[(ascii(x) >> b) & 1 FOR b IN range(8)] FOR x IN string_split(CAST(doc_id AS VARCHAR), '')])"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: CASE WHEN c & 1 <> b THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
    short = (times - 1) * -(-least // times)  # words that a run shares with itself, moved by its period, at least
    short = min(short, least - 1)
    same = " AND ".join(f"x.w{k} = y.w{k}" for k in range(short))
    return f"""
WITH c AS (SELECT doc_id, CAST({crc} AS BIGINT) AS h, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
b AS (SELECT *, h // 10 AS g, len(w) AS n FROM c),
v AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM b WHERE n > 0),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN [w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] FOR i IN range(n)] ELSE w END AS w FROM v),
x AS (SELECT doc_id, n, unnest(range(n - {short - 1})) AS i, {", ".join(f"unnest(w[{k + 1}:n-{short - 1 - k}]) AS w{k}" for k in range(short))} FROM t WHERE n >= {least}),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM x JOIN x AS y ON x.doc_id = y.doc_id AND {same} AND y.i > x.i AND {times} * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + {short - 1} + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS block FROM e) GROUP BY doc_id, q, block),
r AS (SELECT doc_id, start, length, CAST(min(q) AS BIGINT) AS period FROM s
  WHERE length >= {times} * q AND length >= {least} GROUP BY doc_id, start, length),
best AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM r GROUP BY doc_id),
top AS (SELECT * FROM r AS o WHERE NOT EXISTS (SELECT 1 FROM r AS z WHERE z.doc_id = o.doc_id AND (z.length * o.period > o.length * z.period
  OR (z.length * o.period = o.length * z.period AND (z.start < o.start OR (z.start = o.start AND z.period < o.period)))))),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
left_ AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS w, unnest(range(n)) AS i FROM t)
  ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT c.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM c LEFT JOIN best USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN left_ USING (doc_id)"""


def lexical_search(k: int = 20) -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    terms = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{term}')) AS t"
    return f"""
WITH x AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, {terms} FROM documents) GROUP BY doc_id, t),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM x GROUP BY doc_id),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM d),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM x, c GROUP BY t),
m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // tokens AS m FROM d, c),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, {terms} FROM benchmark) GROUP BY item_id, t),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN x USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {k}"""
