"""DuckDB texts of the registered queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, {word}) AS w FROM {docs}),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' ')) END) AS s FROM w),
sets AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(any_value(s)) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
e AS (SELECT rep, n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= {percent} * (na + nb - k)),
reach(node, seen) AS (SELECT rep, rep FROM sets UNION SELECT l.b, r.seen FROM reach r JOIN links l ON l.a = r.node),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
"""

OP1 = NEAR.format(lower=LOWER, word=WORD, docs="documents", size=4, percent=80) + """
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(comp.component, s.doc_id) AS component_id,
  s.doc_id = coalesce(comp.component, s.doc_id) AS kept, coalesce(sets.rep, s.doc_id) AS class_id,
  CASE WHEN sets.rep IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY sets.rep) END AS n_members
FROM s LEFT JOIN sets ON list_sort(s.s) = sets.s LEFT JOIN comp ON comp.node = sets.rep
"""

HITS = r"""
d AS (SELECT doc_id, regexp_extract_all({lower}, {word}) AS w FROM {docs}),
b AS (SELECT item_id, regexp_extract_all({lower}, {word}) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), {size}) AS l, array_to_string(w[i:i + least(len(w), {size}) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - {size}, 0) + 2)) t(i) WHERE len(w) > 0),
hits AS (
  SELECT d.doc_id, bw.item, p.i, bw.l FROM (
    SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM d, (SELECT DISTINCT l FROM bw) x, unnest(range(1, len(w) - l + 2)) t(i)) p
  JOIN d USING (doc_id) JOIN bw ON bw.g = p.g AND bw.l = p.l)
"""

OP5 = "WITH " + HITS.format(lower=LOWER, word=ALNUM, size=10, docs="documents") + """,
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id),
places AS (SELECT doc_id, count(DISTINCT pos) AS n FROM hits, unnest(range(i, i + l)) t(pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items.items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items.items, ','), '')) AS items_sha256,
  coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN places USING (doc_id)
"""

LINE_CTES = r"""
raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {docs} WHERE text IS NOT NULL),
l AS (SELECT doc_id, i - 1 AS pos, regexp_extract_all(ls[i], {word}) AS w FROM raw, unnest(range(1, len(ls) + 1)) t(i)),
c AS (SELECT doc_id, pos, array_to_string(w, ' ') AS c, len(w) AS n, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l WHERE len(w) > 0),
v AS (SELECT *, upto - n AS before FROM c),
f AS (
  SELECT doc_id, pos AS first, max(pos) OVER x AS last, max(upto) OVER x - before AS words, list(c) OVER x AS content FROM v
  WINDOW x AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {less} FOLLOWING)
  UNION
  SELECT doc_id, min(pos) OVER y, pos, upto - min(before) OVER y, list(c) OVER y FROM v
  WINDOW y AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {less} PRECEDING AND CURRENT ROW)),
o AS (SELECT *, min((doc_id, first)) OVER (PARTITION BY content) AS origin FROM f WHERE words > {less}),
gone AS (SELECT doc_id, list_sort(list(DISTINCT pos)) AS gone FROM o, unnest(range(first, last + 1)) t(pos) WHERE (doc_id, first) <> origin GROUP BY doc_id),
kept AS (
  SELECT raw.doc_id, ls, coalesce(gone, []) AS gone,
    list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(coalesce(gone, []), i - 1)), lambda i: ls[i]) AS stay
  FROM raw LEFT JOIN gone USING (doc_id))
"""

OP9 = "WITH " + LINE_CTES.format(docs="documents", word=WORD, less=49) + """
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_deleted,
  coalesce(array_to_string(gone, ','), '') AS deleted_lines, sha256(array_to_string(stay, chr(10))) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_name, coalesce(source, '') AS name, len(regexp_extract_all(coalesce(text, ''), {word})) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '-17') AS key FROM documents),
a AS (SELECT no_name, name, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY no_name, name),
r AS (SELECT *, row_number() OVER (ORDER BY no_name, name) AS rank, 3 * words AS cap FROM a),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, cap / ((rank - 1) % 3 + 1) AS full_at, CAST(sum(words) OVER () AS DOUBLE) AS budget FROM r),
o AS (
  SELECT *, (budget - coalesce(CAST(sum(cap) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
    / CAST(sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS own FROM w),
v AS (SELECT *, coalesce(max(CASE WHEN full_at > own THEN own END) OVER (), max(full_at) OVER ()) AS level FROM o),
s AS (SELECT *, CASE WHEN full_at <= level THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM v),
c AS (SELECT d.*, CAST(sum(size) OVER (PARTITION BY no_name, name ORDER BY key, doc_id, size) AS BIGINT) AS upto FROM d),
x AS (
  SELECT c.doc_id, c.size, c.key, s.rank, s.budget, (e * s.words + c.upto) / s.weight AS x, s.level
  FROM c JOIN s USING (no_name, name), unnest([0, 1, 2]) t(e) WHERE c.size > 0),
y AS (SELECT *, sum(size) OVER (ORDER BY x, rank, key, doc_id) AS run FROM x WHERE x <= 2 * level),
n AS (SELECT doc_id, count(*) AS copies FROM y WHERE run <= budget GROUP BY doc_id)
SELECT c.doc_id, CAST(c.size AS BIGINT) AS size, s.words AS source_size, s.target, CAST(c.size * coalesce(n.copies, 0) AS BIGINT) AS taken
FROM c JOIN s USING (no_name, name) LEFT JOIN n USING (doc_id)
""".format(word=WORD)

# Base32 of the SHA-1 hex text: 32 groups of five bits.
OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, upper(sha1(html)) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789ABCDEF', hex[i]) - 1) + 1, 4)), '') AS bits FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN bits[5 * i + j + 1] = '1' THEN (16 >> j) ELSE 0 END))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

OP12 = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
places AS (SELECT DISTINCT host, path FROM p),
fits AS (
  SELECT host, path, max((length(rh || rp), v, rh || rp)) AS best FROM places, rules
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum(quality) AS k FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
c AS (SELECT host, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(coalesce(sum(k), 0) AS BIGINT) AS k FROM p LEFT JOIN o USING (page_id) GROUP BY host),
bare AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM c),
parts AS (
  SELECT *, string_split(bare, '.') AS ls, regexp_matches(bare, '^[0-9.]+$') AS digits,
    CASE WHEN regexp_matches(bare, '(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z][a-z]$') THEN 2 ELSE 1 END AS m FROM bare),
h AS (
  SELECT host, n, k, CASE WHEN digits THEN '' ELSE array_to_string(ls[-m:], '.') END AS suffix,
    CASE WHEN digits THEN bare ELSE array_to_string(ls[-(m + 1):], '.') END AS domain FROM parts),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM h) AS prior FROM h GROUP BY suffix),
""" + ",\n".join(
    f"""{x}w AS (SELECT coalesce(1 / least(greatest(sum(CASE WHEN n > 0 THEN n * (CAST(k AS DOUBLE) / n - prior) * (CAST(k AS DOUBLE) / n - prior) - prior * (1 - prior) END)
  / nullif(sum(CASE WHEN n > 0 THEN (n - 1) * prior * (1 - prior) END), 0), 0.002e0), 0.5e0), 2e0) - 1 AS w FROM {x}0),
{x} AS (SELECT *, (k + w * prior) / (n + w) AS mean FROM {x}0, {x}w){more}"""
    for x, more in (
        ("s", ",\nd0 AS (SELECT domain, a.n, a.k, s.mean AS prior FROM (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix) a JOIN s USING (suffix))"),
        ("d", ",\nh0 AS (SELECT h.host, h.n, h.k, d.mean AS prior FROM h JOIN d USING (domain))"),
        ("h", ""),
    )
).replace("\nh AS (SELECT *, (k", "\nr AS (SELECT *, (k") + """
SELECT p.page_id, p.host, p.path, best[3] AS rule,
  coalesce(best[2], CASE WHEN round(mean + 1.645 * sqrt(mean * (1 - mean) / (n + w + 1)), 9) < 0.7 THEN 'block' ELSE 'allow' END) AS verdict,
  n AS labelled, round(mean, 9) AS mean, round(mean + 1.645 * sqrt(mean * (1 - mean) / (n + w + 1)), 9) AS upper
FROM p JOIN r USING (host) LEFT JOIN fits USING (host, path)
"""


def _merkle(levels: int = 8, group_levels: int = 3, fanout: int = 8) -> str:
    """Trees of up to fanout ** levels rows a group, level by level, and of the groups above them."""

    def value(column: str) -> str:
        text = f"CAST({column} AS VARCHAR)"
        return f"CASE WHEN {column} IS NULL THEN '-' ELSE CAST(strlen({text}) AS VARCHAR) || ':' || {text} END"

    fields = " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "flatten(list_transform(range(1, len(id) + 1), lambda i: list_transform(range(0, 8), lambda j: (ord(id[i]) >> j) & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"
    parts = [
        f"""d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, coalesce('1' || lang, '0') AS g, sha256({fields} || {value('text')}) AS leaf,
  sha256({fields} || {value(lowered)}) AS lowered FROM documents)""",
        f"t AS (SELECT *, CASE WHEN id IS NOT NULL AND {crc} % 3 = 0 THEN lowered ELSE leaf END AS now FROM d)",
        """t0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM t)""",
        "n0 AS (SELECT g, r, n, leaf AS h FROM t0)",
    ]

    def tree(n: str, depth: int):
        for i in range(depth):
            parts.append(f"{n}x{i} AS (SELECT g, r // {fanout} AS r, any_value(n) AS n, list(h ORDER BY r) AS hs FROM {n}{i} WHERE n > 1 GROUP BY g, r // {fanout})")
            parts.append(f"{n}{i + 1} AS (SELECT g, r, (n + {fanout - 1}) // {fanout} AS n, sha256(array_to_string(hs, '')) AS h FROM {n}x{i})")
        parts.append(f"{n}r AS (" + " UNION ALL ".join(f"SELECT g, h FROM {n}{i} WHERE n = 1" for i in range(depth + 1)) + ")")

    def climb(n: str, t: str, depth: int):
        """Folds ``now`` and gathers siblings of t's rows (g, r, now, proof) up the tree n; t ends as t + depth."""
        for i in range(depth):
            place = f"(t.r // {fanout ** i}) % {fanout}"
            before, after = f"array_to_string(x.hs[1:{place}], '')", f"array_to_string(x.hs[{place} + 2:], '')"
            parts.append(
                f"""{t}{i + 1} AS (SELECT t.* REPLACE (CASE WHEN x.hs IS NULL THEN t.now ELSE sha256({before} || t.now || {after}) END AS now,
  CASE WHEN x.hs IS NULL THEN t.proof ELSE t.proof || {before} || {after} END AS proof)
  FROM {t}{i} t LEFT JOIN {n}x{i} x ON x.g = t.g AND x.r = t.r // {fanout ** (i + 1)})"""
            )

    tree("n", levels)
    parts.append("m0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS r, count(*) OVER () AS n, h, g AS own FROM nr)")
    tree("m", group_levels)
    parts.append("u0 AS (SELECT t0.*, '' AS proof FROM t0)")
    climb("n", "u", levels)
    parts.append(f"v0 AS (SELECT u.* REPLACE ('' AS g, m0.r AS r), m0.h AS subroot FROM u{levels} u JOIN m0 ON m0.own = u.g)")
    climb("m", "v", group_levels)
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, mr.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = mr.h AS verified FROM v{group_levels}, mr
"""


OP13 = _merkle()

ORACLE = {"op12_reputation": OP12, "op13_merkle": OP13, "op7_warc": OP7, "op8_mixing": OP8, "op1_minhash": OP1, "op5_decontaminate": OP5, "op9_lines": OP9}
