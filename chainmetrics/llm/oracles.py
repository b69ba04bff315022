"""SQL (DuckDB) of the operators' contracts that SQL can express, by the definitions alone: no sketches, no fingerprints."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Components of documents whose sets of n-word shingles are alike. Distinct sets are compared pair by pair; what links reach is a recursive union over them.
_COMPONENTS = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - MORE, 1) + 1), lambda i: array_to_string(w[i:i + MORE], ' ')))) END AS s FROM words
), classes AS (
  SELECT row_number() OVER () AS c, s, len(s) AS n, min(doc_id) AS least_id FROM sets GROUP BY s
), members AS (
  SELECT c, n, unnest(s) AS shingle FROM classes
), links AS (
  SELECT a.c AS a, b.c AS b FROM members a JOIN members b ON a.shingle = b.shingle AND a.c <> b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT c, c AS other FROM classes
  UNION
  SELECT reach.c, links.b FROM reach JOIN links ON links.a = reach.other
), components AS (
  SELECT reach.c, min(classes.least_id) AS component_id FROM reach JOIN classes ON classes.c = reach.other GROUP BY reach.c
)
SELECT doc_id, CAST(classes.n AS BIGINT) AS n_shingles, CASE WHEN classes.n = 0 THEN doc_id ELSE component_id END AS component_id
FROM sets JOIN classes ON classes.s = sets.s JOIN components ON components.c = classes.c
"""
NEAR_DUPLICATES = f"SELECT *, coalesce(n_shingles = 0 OR doc_id = component_id, false) AS kept FROM ({_COMPONENTS.replace('MORE', '3')})"
JACCARD_JOIN = _COMPONENTS.replace("MORE", "4")

_ITEM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
#: Every window of an item against every window of a document that is as long.
DECONTAMINATION = rf"""
WITH items AS (
  SELECT item_id, regexp_extract_all({_LOWER}, {_ITEM_WORDS}) AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ITEM_WORDS}) AS w FROM documents
), occurring AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), hits AS (
  SELECT r, i, k, item_id FROM occurring JOIN windows USING (k, win)
), hit_words AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS place FROM hits) GROUP BY r
), hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

#: Every string of 200 bytes (400 hexadecimal digits) grouped by its digest; runs of covered bytes by gaps between starts.
REPEATED_SUBSTRINGS = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT r, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS digest FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM docs)
), twice AS (
  SELECT digest FROM starts GROUP BY digest HAVING count(*) > 1
), hit AS (
  SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true) AS opens FROM starts WHERE digest IN (SELECT digest FROM twice)
), grouped AS (
  SELECT r, i, sum(CAST(opens AS BIGINT)) OVER (PARTITION BY r ORDER BY i) AS run FROM hit
), runs AS (
  SELECT r, run, min(i) AS first, max(i) + 200 AS stop FROM grouped GROUP BY r, run
), pieces AS (
  SELECT r, first AS place, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY first), 0) AS begin, first AS stop, stop - first AS removed, 1 AS spans FROM runs
  UNION ALL
  SELECT r, len(h) // 2 AS place, coalesce(last_stop, 0), len(h) // 2, 0, 0 FROM docs LEFT JOIN (SELECT r, max(stop) AS last_stop FROM runs GROUP BY r) USING (r)
), kept AS (
  SELECT r, sum(removed) AS removed, sum(spans) AS spans, string_agg(substr(h, CAST(2 * begin + 1 AS BIGINT), CAST(2 * (pieces.stop - begin) AS BIGINT)), '' ORDER BY place, spans DESC) AS rest
  FROM pieces JOIN docs USING (r) GROUP BY r
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM docs JOIN kept USING (r)
"""



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text: its bytes bit by bit, the lowest first, through the reversed polynomial."""
    mixed = f"xor(crc, CASE WHEN bit % 8 = 0 THEN ord(substr({text}, bit // 8 + 1, 1)) ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295, range(0, 8 * length({text}))), lambda crc, bit: xor({mixed} >> 1, ({mixed} & 1) * 3988292384)), 4294967295)"


#: Nodes are prefixes, as lists; a node's row for each of its own prefixes gives the sums over subtrees.
PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), dealt AS (
  SELECT *, {_crc32('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM turns
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(d.t[1:c.h], []), c.t[c.h + 1:]) AS t FROM dealt c LEFT JOIN dealt d ON d.conv_id = c.conv_id - c.conv_id % 5
), steps AS (
  SELECT conv_id, t[1:d] AS p, d AS depth, d = len(t) AS ends FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT p, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM steps GROUP BY p
), children AS (
  SELECT p[1:len(p) - 1] AS p, count(*) AS n_children FROM nodes WHERE len(p) > 0 GROUP BY 1
), whole AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(nodes.p[depth].t) END AS saved FROM nodes LEFT JOIN children ON children.p = nodes.p
), sums AS (
  SELECT p[1:d] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM whole) GROUP BY 1
)
SELECT whole.conv_id, whole.depth, up.conv_id AS parent_conv_id, whole.n_convs, whole.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(whole.ids) AS ends_sha256
FROM whole JOIN sums ON sums.p = whole.p LEFT JOIN nodes up ON whole.depth > 0 AND up.p = whole.p[1:whole.depth - 1]
"""


def _repair_sql() -> str:
    """A row at a time through the four states; each holds the least of {cost, audit, repaired rows}."""
    role, text = "role", "text"
    more = "CASE WHEN fault = 3 THEN 5 ELSE 0 END"
    bar = "CASE WHEN fault IN (1, 2) {0} THEN 1000000 ELSE 0 END"
    step = lambda q, cost, edit, line=None: f"{{'c': {q}.c + {cost}, 'a': {q}.a || '{edit}', 'r': " + (f"list_append({q}.r, {line})" if line else f"{q}.r") + "}"
    delete = lambda q: step(q, 2, "D")
    keep = lambda q, initial: step(q, f"{more} + {bar.format(f'OR role[1:1] <> {initial!r}')}", "K", f"{role} || ':' || {text}")
    rerole = lambda q, to: step(q, f"1 + {more} + {bar.format('')}", "R", f"'{to}:' || {text}")
    put = lambda q, to: step(q, 5, "I", f"'{to}:'")
    least = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
    none = "{'c': 1000000, 'a': '', 'r': CAST([] AS VARCHAR[])}"
    user = [f(q, w) for q in ("q0", "q1", "q3") for f, w in ((keep, "u"), (rerole, "user"))]
    read = f"{delete('q0')} AS q0, {least(delete('q1'), keep('q0', 's'))} AS q1, {least(delete('q2'), *user)} AS q2, {least(delete('q3'), keep('q2', 'a'), rerole('q2', 'assistant'))} AS q3"
    closed = lambda source, columns: f"SELECT {columns}, q0, q1, q2, {least('q3', put('q2', 'assistant'))} AS q3 FROM (SELECT * REPLACE ({least('q2', *(put(q, 'user') for q in ('q0', 'q1', 'q3')))} AS q2) FROM {source})"
    return f"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE kind <> 0
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS i, lag(role) OVER w AS before,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault
  FROM seen WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before[1:1] || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal FROM placed GROUP BY conv_id
), lattice AS (
  SELECT conv_id, 0 AS i, {{'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])}} AS q0, {none} AS q1, {{'c': 5, 'a': 'I', 'r': ['user:']}} AS q2, {{'c': 10, 'a': 'II', 'r': ['user:', 'assistant:']}} AS q3 FROM counts
  UNION ALL
  {closed(f"(SELECT lattice.conv_id, lattice.i + 1 AS i, {read} FROM lattice JOIN placed ON placed.conv_id IS NOT DISTINCT FROM lattice.conv_id AND placed.i = lattice.i + 1)", 'conv_id, i')}
), ended AS (
  SELECT lattice.conv_id, {least('q0', 'q3')} AS best FROM lattice JOIN counts ON counts.conv_id IS NOT DISTINCT FROM lattice.conv_id AND i = n
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


REPAIR = _repair_sql()

ORACLES = {
    "op1_minhash_near_dedup": NEAR_DUPLICATES,
    "op2_winnowing_decontamination": DECONTAMINATION,
    "op8_suffix_dedup": REPEATED_SUBSTRINGS,
    "op11_conversation_repair": REPAIR,
    "op12_partenum_jaccard_join": JACCARD_JOIN,
    "op13_prefix_trie": PREFIX_TRIE,
}
