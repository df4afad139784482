"""The numbered queries in SQL, where SQL can express them."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, url FROM pages), q AS (SELECT *, CAST(strlen(h) AS BIGINT) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to, url FROM q"""

OP5 = f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="text")} AS words FROM documents),
x AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS pos FROM w),
v AS (SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 19], chr(10))) AS h FROM x),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM v),
d AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS place FROM f WHERE k > 1),
r AS (SELECT doc_id, list(place) AS places FROM d GROUP BY 1),
k AS (SELECT w.doc_id, w.words, coalesce(r.places, []) AS places FROM w LEFT JOIN r USING (doc_id)),
u AS (SELECT z.doc_id, z.words[z.i] AS word, z.i FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w) z ANTI JOIN d ON d.doc_id = z.doc_id AND d.place = z.i),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u GROUP BY 1)
SELECT k.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM k LEFT JOIN t USING (doc_id)"""



def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit: each byte is mixed in and followed by eight shifts (-1)."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [CAST(unicode(ch) AS BIGINT), {', '.join(['-1'] * 8)}]))"
    return f"""xor(list_reduce(list_concat([4294967295], {steps}), lambda a, v: CASE WHEN v >= 0 THEN xor(a, v)
 ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""


OP11 = f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
 CAST(len({WORDS.format(text="text")}) AS BIGINT) AS w FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(h ORDER BY i) AS hs, list(w ORDER BY i) AS ws, {crc32("CAST(conv_id AS VARCHAR)")} % 4 AS n FROM o GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.hs[:c.n], []), c.hs[c.n + 1:]) AS hs, list_concat(coalesce(b.ws[:c.n], []), c.ws[c.n + 1:]) AS ws FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, len(hs) AS size, d, array_to_string(hs[:d], ',') AS k, CASE WHEN d > 0 THEN array_to_string(hs[:d - 1], ',') END AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(hs) + 1)) AS d FROM r)),
n AS (SELECT k, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '') AS ends FROM p GROUP BY k, d),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS m FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(kids.m, 0) AS n_children FROM n LEFT JOIN kids ON kids.k = n.k AND kids.d = n.d),
own AS (SELECT DISTINCT p.k AS above, p.d AS above_d, m.k, m.d, m.n_children, m.saved FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d),
s AS (SELECT above, above_d, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM own GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON s.above = m.k AND s.above_d = m.d LEFT JOIN n q ON q.k = m.up AND q.d = m.d - 1"""

_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"


def _tree(of: str, leaves: str) -> str:
    """The levels of every tree, and each node's siblings left and right."""
    return f"""
{of}(tree, lvl, pos, h, c) AS (SELECT tree, 0, pos, h, c FROM ({leaves}) UNION ALL
 SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (c + 2) // 3 FROM {of} WHERE c > 1 GROUP BY tree, lvl, c, pos // 3),
{of}_sides AS (SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
 coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r FROM {of} a LEFT JOIN {of} b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 AND a.pos <> b.pos WHERE a.c > 1 GROUP BY ALL)"""


def _fold(name: str, of: str, start: str) -> str:
    return f"""
{name}_all(k, tree, lvl, pos, cur, proof) AS ({start} UNION ALL SELECT k, z.tree, z.lvl + 1, z.pos // 3, sha256(s.l || cur || s.r), proof || s.l || s.r FROM {name}_all z JOIN {of}_sides s ON s.tree = z.tree AND s.lvl = z.lvl AND s.pos = z.pos),
{name} AS (SELECT k, arg_max(tree, lvl) AS tree, arg_max(cur, lvl) AS cur, arg_max(proof, lvl) AS proof FROM {name}_all GROUP BY k)"""


OP13 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')").replace("CAST(replace(text, chr(10), '') AS VARCHAR)", "replace(text, chr(10), '')")} END AS other FROM documents),
g AS (SELECT row_number() OVER () AS k, *, coalesce(other, leaf) AS got, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS pos, count(*) OVER (PARTITION BY source) AS c FROM d),
{_tree("own", "SELECT tree, pos, leaf AS h, c FROM g")},
{_tree("tops", "SELECT 0 AS tree, tree AS pos, h, count(*) OVER () AS c FROM own WHERE c = 1")},
{_fold("low", "own", "SELECT k, tree, 0, pos, got, '' FROM g")},
{_fold("high", "tops", "SELECT k, 0, 0, tree, cur, proof FROM low")}
SELECT g.doc_id, g.leaf, own.h AS subroot, tops.h AS root, sha256(high.proof) AS proof_sha256, high.cur AS folded_root, high.cur = tops.h AS verified
FROM g JOIN high USING (k) JOIN own ON own.tree = g.tree AND own.c = 1 JOIN tops ON tops.c = 1"""

OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 4], chr(10))) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.size + y.size - both_have)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.size, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.least, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id"""


def _find(kind: int, pattern: str, group: int, condition: str) -> str:
    """Matches with their places: the pieces between matches, and the matches, add up to them."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, CAST(coalesce(list_sum(list_transform(pieces[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start,
 CAST(length(found[i]) AS BIGINT) AS size, found[i] AS m, parts[i] AS part FROM (SELECT doc_id, found, parts, string_split_regex(text, '{p}') AS pieces, unnest(range(1, len(found) + 1)) AS i FROM
 (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS found, regexp_extract_all(text, '{p}', {group}) AS parts FROM documents WHERE text IS NOT NULL)) WHERE {condition}"""


def op2() -> str:
    from quarrylens.llm import secrets as s

    found = [_find(i, p, 1 if k == "assign" else 0, f"length(parts[i]) >= {least}") for i, (k, p, least) in enumerate(s.BASE)]
    found += [_find(len(s.BASE) + i, p, 0, " AND ".join([f"regexp_matches(found[i], '{n}')" for n in s.NEEDS.get(k, ())]) or "true") for i, (k, p) in enumerate(s.WEAK)]
    of = lambda kinds: "(" + ", ".join(str(s.KINDS.index(k)) for k in kinds) + ")"
    names = "[" + ", ".join(f"'{k}'" for k in [*s.KINDS, "linked"]) + "]"
    near = f"b.start - a.stop <= {s.SCOPE_CHARS} AND a.start - b.stop <= {s.SCOPE_CHARS}"
    label = f"{names}[kind + 1] || ':' || start || ':' || stop"
    return f"""
WITH x AS (SELECT doc_id, kind, start, start + size AS stop FROM ({" UNION ALL ".join(found)})), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop, kind) AS k FROM x),
s AS (SELECT a.doc_id, a.k, b.kind IN {of(s.SECRETS)} AS is_secret, b.kind IN {of(s.ENDPOINTS)} AS is_end, b.kind IN {of(s.IDENTIFIERS)} AS is_id, b.start, b.stop FROM o a JOIN o b ON a.doc_id = b.doc_id AND {near}),
g AS (SELECT doc_id, k, bool_or(is_secret) AS hs, bool_or(is_id) AS hi, min(start) FILTER (WHERE is_secret OR is_end) AS lo, max(stop) FILTER (WHERE is_secret OR is_end) AS up FROM s GROUP BY ALL),
j AS (SELECT o.*, hs, hi, lo, up FROM o JOIN g ON g.doc_id = o.doc_id AND g.k = o.k),
l AS (SELECT DISTINCT doc_id, {len(s.KINDS)} AS kind, least(start, lo) AS start, greatest(stop, up) AS stop FROM j WHERE kind IN {of(s.IDENTIFIERS)} AND hs),
a AS (SELECT doc_id, kind, start, stop FROM j WHERE kind < {len(s.BASE)} OR (kind IN {of(("login", "endpoint"))} AND hs) OR (kind IN {of(("blob",))} AND hi) UNION ALL SELECT doc_id, kind, start, stop FROM l),
t AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, (k, *_) in enumerate(s.BASE))}, string_agg({label}, ',' ORDER BY start, kind, stop) FILTER (WHERE kind < {len(s.BASE)}) AS base, string_agg({label}, ',' ORDER BY start, kind, stop) AS spans FROM a GROUP BY 1)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k, *_ in s.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN t USING (doc_id)"""
