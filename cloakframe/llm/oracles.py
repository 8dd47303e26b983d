"""DuckDB SQL for the corpus queries that SQL can express.

The others learn, pack, draw by hashes that DuckDB lacks or answer
approximately; tests compare them with plain versions.
"""

from __future__ import annotations

from cloakframe.llm.secret_scan import ACCESS, ASSIGN, ASSIGN_MIN, CLASSES, HEX, EntropyClass


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _located(text: str, pattern: str) -> str:
    """List of {start, end, value} of all matches, from the gaps between them."""
    found, gaps = f"regexp_extract_all({text}, {_text(pattern)})", f"string_split_regex({text}, {_text(pattern)})"
    before = lambda n: f"CAST(coalesce(list_sum(list_transform({gaps}[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform({found}[1:{n}], lambda g: length(g))), 0) AS BIGINT)"
    return f"list_transform(range(1, len({found}) + 1), lambda i: {{'s': {before('i - 1')}, 'e': {before('i')}, 'v': {found}[i]}})"


def _hot(rule: EntropyClass) -> str:
    """Starts of windows at or above the threshold: the entropy of each window by itself."""
    entropy = f"list_aggregate(string_split(substr(x.v, CAST(w AS BIGINT) + 1, {rule.window}), ''), 'entropy')"
    return f"list_filter(range(0, length(x.v) - {rule.window} + 1), lambda w: {entropy} >= {rule.threshold})"


def _entropy(rule: EntropyClass, rank: int, before: str) -> str:
    fit = " AND ".join([*(f"regexp_matches(x.v, {_text(p)})" for p in rule.need), *(f"NOT regexp_matches(x.v, {_text(p)})" for p in rule.allow)])
    return (
        f"c{rank} AS (SELECT doc_id, x, {_hot(rule)} AS hot FROM (SELECT doc_id, unnest({_located('t', rule.pattern)}) AS x FROM d) WHERE {fit}), "
        f"n{rank} AS (SELECT c.doc_id, x.s + hot[1] AS s, {rank} AS r, x.s + hot[-1] + {rule.window} AS e, 'entropy_{rule.name}' AS k FROM c{rank} c WHERE len(hot) > 0 "
        f"AND NOT EXISTS (SELECT 1 FROM {before} b WHERE b.doc_id = c.doc_id AND b.s < x.s + hot[-1] + {rule.window} AND x.s + hot[1] < b.e)), "
        f"a{rank} AS (SELECT * FROM {before} UNION ALL SELECT * FROM n{rank})"
    )


def _secrets() -> str:
    base = " UNION ALL ".join(
        f"SELECT doc_id, x.s AS s, {rank} AS r, x.e AS e, '{kind}' AS k FROM (SELECT doc_id, unnest({_located('t', pattern)}) AS x FROM d) {where}"
        for rank, (kind, pattern, where) in enumerate((("assign", ASSIGN, f"WHERE length(regexp_extract(x.v, {_text(ASSIGN)}, 2)) >= {ASSIGN_MIN}"), ("access", ACCESS, ""), ("hex", HEX, "")))
    )
    more, before = [], "a2"
    for n, rule in enumerate(CLASSES):
        more.append(_entropy(rule, 3 + n, before))
        before = f"a{3 + n}"
    joined = "coalesce(string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, r), '')"
    counts = ", ".join(f"count(*) FILTER (k = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a2 AS ({base}), {', '.join(more)} "
        f"SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER (r < 3), '')) AS base_sha256, {joined} AS spans FROM d LEFT JOIN {before} USING (doc_id) GROUP BY d.doc_id"
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NEAR = (
    "WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '" + _UPPER + "', '" + _UPPER.lower() + "'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents), "
    "s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w), "
    "n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), u AS (SELECT doc_id, n, unnest(s) AS x FROM s JOIN n USING (doc_id)), "
    # a pair at 0.8 shares one of the rarest fifth (and one more) of the shingles of either
    "f AS (SELECT x, count(*) AS f FROM u GROUP BY x), r AS (SELECT u.*, row_number() OVER (PARTITION BY doc_id ORDER BY f, u.x) AS k FROM u JOIN f USING (x)), "
    "p AS (SELECT * FROM r WHERE k <= n - ceil(0.8 * n) + 1), "
    "c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)), "
    "l AS (SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))), "
    "e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), "
    "t(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.doc_id AND t.root < e.b) "
    "SELECT n.doc_id, n.n AS n_shingles, m.root AS component_id, m.root = n.doc_id AS kept FROM n JOIN (SELECT doc_id, min(root) AS root FROM t GROUP BY doc_id) m USING (doc_id)"
)

_MIDDLE = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256(concat('1:', doc_id)) AS h FROM documents), "
    "r AS (SELECT *, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS h4 FROM d), "
    "c AS (SELECT *, least(h4[1] % (n + 1), h4[2] % (n + 1)) AS a, greatest(h4[1] % (n + 1), h4[2] % (n + 1)) AS b, "
    "CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h4[3] % 100 >= 90 THEN 'plain' WHEN h4[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r), "
    "p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c) "
    "SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars, "
    "sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"
)

ORACLES: dict[str, str] = {"op1_secret_scan": _secrets(), "op10_minhash_dedup": _NEAR, "op13_fill_middle": _MIDDLE}
