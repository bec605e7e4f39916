"""The same questions in DuckDB SQL, where it has the means; written directly, not like the operators."""

from __future__ import annotations

from logvane.llm import chat, urls

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRING = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, array_to_string(ws[i + 1:i + 13], ' ') AS s, i
 FROM (SELECT doc_id, ws, unnest(range(len(ws) - 12)) AS i FROM w)),
firsts AS (SELECT s, min(doc_id) AS first FROM starts GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM starts JOIN firsts USING (s), (SELECT unnest(range(13)) AS j) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def _rule(part: str) -> str:
    ordered = sorted(urls.RULES, key=lambda r: (-len(r.name), r.verdict))
    cases = " ".join(
        f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}') THEN '{getattr(r, part)}'"
        for r in ordered
    )
    return f"CASE {cases} END"


def _parts(url: str) -> str:
    """host, path and page of a url."""
    rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({rest}, '^[^?#]*(\\?[^#]*)?', 1)"
    return f"{host} AS host, {path} AS path, CASE WHEN {host} <> '' THEN {host} || {path} || {query} END AS node"


URLS = rf"""
WITH RECURSIVE p AS (SELECT page_id, html, {_parts("coalesce(url, '')")} FROM pages),
tags AS (SELECT host, path, node, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p),
named AS (SELECT host, path, node, replace(CASE
  WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?is)^<meta\b.*http-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
  ELSE '' END, '&amp;', '&') AS link FROM tags),
whole AS (SELECT node AS a, CASE WHEN contains(link, '://') THEN link WHEN prefix(link, '//') THEN 'http:' || link
  WHEN prefix(link, '/') THEN 'http://' || host || link WHEN prefix(link, '?') THEN 'http://' || host || path || link
  ELSE 'http://' || host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || link END AS url
  FROM named WHERE link <> '' AND node IS NOT NULL),
edges AS (SELECT a, node AS b FROM (SELECT a, {_parts("url")} FROM whole) WHERE node IS NOT NULL),
ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
near AS (SELECT DISTINCT node AS a, node AS b FROM p WHERE node IS NOT NULL
 UNION SELECT near.a, ways.b FROM near JOIN ways ON ways.a = near.b),
alias AS (SELECT a AS node, count(*) AS aliases, max(ruled) FILTER (ruled = 'allow') AS allowed, max(ruled) FILTER (ruled = 'block') AS blocked
 FROM (SELECT a, {_rule("verdict")} AS ruled FROM (SELECT a, {_parts("'http://' || b")} FROM near)) GROUP BY a)
SELECT page_id, host, path, {_rule("name")} AS rule,
 coalesce({_rule("verdict")}, CASE WHEN allowed IS NULL AND blocked IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
 coalesce(aliases, 1) AS aliases
FROM p LEFT JOIN alias USING (node)
"""

_CONTROL = r"[<\[]\\*(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\])"


def _escaped(text: str) -> str:
    """Length of a text with its control strings escaped."""
    return f"length({text}) + len(regexp_extract_all({text}, '{_CONTROL}'))"


CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
 (sum({_escaped("text")} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 15
  ELSE 17 + {_escaped("role")} END) + 3 * (max(k) // {chat.PART_TURNS} + 1))::BIGINT AS formatted_chars,
 max(k) // {chat.PART_TURNS} + 1 AS parts, 0::BIGINT AS rewritten
FROM placed GROUP BY conv_id
"""

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
langs AS (SELECT lang, sum(total) AS whole, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
filled AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY g.lang, g.source) AS n
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, c, 1 + (1000000000 * (c + 2)::HUGEINT) // (n + 2 * v)::HUGEINT AS p,
  1 + (1000000000 * (total + 2)::HUGEINT) // (whole + 2 * v)::HUGEINT AS q FROM filled JOIN langs USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS s
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


_CRC = """list_reduce([4294967295] || list_transform(range(length(doc_id::VARCHAR)), lambda k: ascii(substr(doc_id::VARCHAR, k::INT + 1, 1))::BIGINT),
 lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1))))"""


def _walk(name: str, first: str, nodes: str) -> str:
    """Replaced digests and siblings of every row on its way up."""
    return f"""{name} AS ({first}
 UNION ALL SELECT w.r, w.tree, w.l + 1, w.i // 3, (w.n + 2) // 3, sha256(string_agg(CASE WHEN s.i = w.i THEN w.v ELSE s.h END, '' ORDER BY s.i)),
  w.sibs || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i <> w.i), '')
  FROM {name} w JOIN {nodes} s ON s.tree = w.tree AND s.l = w.l AND s.i // 3 = w.i // 3 WHERE w.n > 1
  GROUP BY w.r, w.tree, w.l, w.i, w.n, w.v, w.sibs)"""


def _tree(name: str, first: str) -> str:
    return f"""{name} AS ({first}
 UNION ALL SELECT tree, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, l, i // 3, n)"""


MERKLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS leaf,
  CASE WHEN {_CRC} & 1 = 1 AND text IS NOT NULL THEN {_leaf("replace(text, chr(10), '')")} END AS changed FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_tree("nodes", "SELECT tree, 0 AS l, i, leaf AS h, n FROM ranked")},
subs AS (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_tree("tops", "SELECT '' AS tree, 0 AS l, i, subroot AS h, n FROM subs")},
{_walk("low", "SELECT r, tree, 0 AS l, i, n, coalesce(changed, leaf) AS v, '' AS sibs FROM ranked", "nodes")},
{_walk("high", "SELECT r, '' AS tree, 0 AS l, subs.i, subs.n, v, sibs FROM low JOIN subs ON source = tree WHERE low.n = 1", "tops")}
SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, v AS folded_root, v = root AS verified,
 length(sibs) // 64 AS n_siblings, changed IS NOT NULL AS changed
FROM high JOIN d USING (r) JOIN subs ON subs.source = d.tree, (SELECT h AS root FROM tops WHERE n = 1) WHERE high.n = 1
"""

SQL = {
    "op5_url_filter": URLS,
    "op8_substring_dedup": SUBSTRING,
    "op11_chat_formatting": CHAT,
    "op12_source_divergence": DIVERGENCE,
    "op13_merkle_manifest": MERKLE,
}
