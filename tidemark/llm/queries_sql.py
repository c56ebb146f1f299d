"""SQL of queries that DuckDB can express but that takes some building."""

from __future__ import annotations

def merkle_sql(depth: int = 7) -> str:
    """The Merkle manifest with the proofs of every row, for up to 8 ** depth rows of a language and as many languages."""

    def enc(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"

    def leaf(text):
        return "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ones, poly = "CAST(4294967295 AS UBIGINT)", "CAST(3988292384 AS UBIGINT)"
    byte = f"list_reduce(list_prepend(xor(a, c), [CAST(b AS UBIGINT) for b in range(8)]), lambda x, b: xor(x >> 1, {poly} * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend({ones}, [CAST(ord(c) AS UBIGINT) for c in string_split(CAST(doc_id AS VARCHAR), '')]), lambda a, c: {byte}), {ones})"
    parts = [
        f"""leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS claim
  FROM documents
), a0 AS (
  SELECT g, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, doc_id, leaf, claim
  FROM leaves
)"""
    ]

    def tree(p):  # every level's nodes (a group of one node stays as it is) and each node's siblings
        for k in range(depth):
            parts.append(f"""{p}{k + 1} AS (
  SELECT g, pos // 8 AS pos, (any_value(n) + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {p}{k} WHERE n > 1 GROUP BY g, pos // 8
  UNION ALL SELECT g, pos, n, h FROM {p}{k} WHERE n = 1
), {p}s{k} AS (
  SELECT x.g, x.pos, x.n > 1 AS hashed, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS before,
    coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS after
  FROM {p}{k} x JOIN {p}{k} y ON x.g = y.g AND x.pos // 8 = y.pos // 8 GROUP BY ALL
)""")

    def climb(p, start):
        for k in range(depth):
            parts.append(f"""{p}p{k + 1} AS (
  SELECT r.* EXCLUDE (fold, sib, spot), CASE WHEN s.hashed THEN sha256(s.before || r.fold || s.after) ELSE r.fold END AS fold,
    CASE WHEN s.hashed THEN r.sib || s.before || s.after ELSE r.sib END AS sib, CASE WHEN s.hashed THEN r.spot // 8 ELSE r.spot END AS spot
  FROM {f"{p}p{k}" if k else start} r JOIN {p}s{k} s ON s.g = r.key AND s.pos = r.spot
)""")

    tree("a")
    parts.append(f"c0 AS (SELECT '' AS g, g AS grp, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM a{depth})")
    tree("c")
    parts.append("own AS (SELECT doc_id, leaf, g AS grp, claim AS fold, '' AS sib, pos AS spot, g AS key FROM a0)")
    climb("a", "own")
    parts.append(f"mid AS (SELECT r.doc_id, r.leaf, r.fold, r.sib, c0.h AS subroot, c0.pos AS spot, '' AS key FROM ap{depth} r JOIN c0 ON c0.grp = r.grp)")
    climb("c", "mid")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM cp{depth} CROSS JOIN (SELECT h AS root FROM c{depth})"""


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), occ AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
cnt AS (SELECT lang, source, term, count(*) AS c FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM groups g LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
p AS (
  SELECT n.lang, n.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (n + 2 * v) AS p
  FROM n JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN cnt ON cnt.lang = n.lang AND cnt.source = n.source AND cnt.term = k.term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (s + 2)) // (sum(s) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, sum(c)::HUGEINT AS s FROM cnt GROUP BY lang, term) JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), both_parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN pairs x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts
) WHERE part = 'pair' OR rank <= 10
"""
