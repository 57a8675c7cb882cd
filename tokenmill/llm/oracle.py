"""DuckDB SQL for the queries of this package that SQL can express.

The settings are spelled out here and not taken from the code under test.
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_RULES = [("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
          ("net", "/", "block")]


def _rule(host: str, path: str, what: int) -> str:
    """The longest fitting rule's name (0) or verdict (1); the list above is longest first."""
    cases = " ".join(
        f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, v)[what]}'"
        for h, p, v in _RULES)
    return f"CASE {cases} END"


def _components(edges: str) -> str:
    """CTEs from ``edges`` (a, b) to ``component`` (node, root): the least node in reach."""
    return f"""
both_ways AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
reach(node, other) AS (
    SELECT a, a FROM both_ways
    UNION
    SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
component AS (SELECT node, min(other) AS root FROM reach GROUP BY node)"""


REDIRECTS = rf"""
WITH RECURSIVE parsed AS (
    SELECT page_id, url, html,
           coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), {_LOWER}), '') AS host,
           coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
           regexp_extract(url, '^.*?://[^?#]*(\?[^#]*)', 1, 's') AS query,
           regexp_extract(url, '^(.*?://)', 1, 's') AS scheme
    FROM pages),
keyed AS (SELECT *, CASE WHEN host <> '' THEN host || path || query END AS key FROM parsed),
tags AS (
    SELECT *,
           list_filter(regexp_extract_all(html, '<link\b[^>]*>', 0, 'is'), lambda t: regexp_matches(
               t, '\brel\s*=\s*["'']?\s*([^"''>]*\s)?canonical[\s"''>/]', 'is')) AS links,
           list_filter(regexp_extract_all(html, '<meta\b[^>]*>', 0, 'is'), lambda t: regexp_matches(
               t, '\bhttp-equiv\s*=\s*["'']?\s*refresh[\s"''>/]', 'is')) AS metas
    FROM keyed),
named AS (
    SELECT *, coalesce(
        nullif(trim(regexp_replace(regexp_extract(links[1], '\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1, 'is'),
                                   '^["'']|["'']$', '', 'g')), ''),
        nullif(trim(regexp_extract(metas[1], '\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*[''"]?\s*([^"''>\s]+)',
                                   1, 'is')), '')) AS target
    FROM tags),
whole AS (
    SELECT key, CASE
        WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN target
        WHEN starts_with(target, '//') THEN regexp_extract(scheme, '^(.*?:)//', 1, 's') || target
        WHEN starts_with(target, '/') THEN scheme || host || target
        WHEN regexp_matches(target, '^[?#]') THEN scheme || host || path || target
        WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN NULL
        ELSE scheme || host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || target END AS other
    FROM named WHERE target IS NOT NULL),
edges AS (
    SELECT a, b FROM (
        SELECT key AS a, CASE WHEN regexp_extract(other, '^.*?://([^/?#]*)', 1, 's') <> '' THEN
            translate(regexp_extract(other, '^.*?://([^/?#]*)', 1, 's'), {_LOWER})
            || regexp_extract(other, '^.*?://[^/?#]*([^?#]*)', 1, 's')
            || regexp_extract(other, '^.*?://[^?#]*(\?[^#]*)', 1, 's') END AS b FROM whole)
    WHERE a <> b),
{_components("edges")},
explicit AS (
    SELECT node, root, {_rule("regexp_extract(node, '^([^/?]*)', 1, 's')",
                              "regexp_extract(node, '^[^/?]*([^?]*)', 1, 's')", 1)} AS verdict
    FROM component),
shared AS (
    SELECT root, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END
        AS spread
    FROM explicit GROUP BY root)
SELECT page_id, host, path, {_rule("host", "path", 0)} AS rule,
       coalesce({_rule("host", "path", 1)}, spread, 'allow') AS verdict
FROM keyed LEFT JOIN explicit ON key = node LEFT JOIN shared USING (root)
"""

COSINES = f"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, CASE WHEN label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS v
    FROM embeddings),
edges AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id < b.vec_id
    WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.98),
{_components("edges")},
degree AS (SELECT a AS vec_id, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id,
       coalesce(root, vec_id) = vec_id AS kept
FROM vectors LEFT JOIN degree USING (vec_id) LEFT JOIN component ON node = vec_id
"""

ARCHIVES = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first FROM payloads)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((('0x' || substr(sha1(html), (5 * i + 1)::INT, 5))::BIGINT >> s) & 31), 1)), '')), '')
           AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM firsts
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM split),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
edges AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id
    HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))),
{_components("edges")}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id,
       coalesce(root, doc_id) = doc_id AS kept
FROM sets LEFT JOIN component ON node = doc_id
"""


def statements() -> dict[str, str]:
    return {"op2_redirect_equivalence": REDIRECTS, "op3_itq_near_dups": COSINES,
            "op6_chained_warc": ARCHIVES, "op10_hyperminhash": NEAR_DUPLICATES}
