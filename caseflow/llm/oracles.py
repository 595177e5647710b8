"""DuckDB SQL for the corpus queries that SQL can express, written from the contracts alone."""

ORACLES: dict[str, str] = {}

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op1_near_dedup"] = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, {WORDS.format(LOWER.format("text"))} AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
    FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets
), items AS (SELECT doc_id, unnest(s) AS g FROM sets
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
    FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * common >= 80 * (p.n + q.n - common)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
    SELECT doc_id, doc_id AS other FROM sizes
    UNION
    SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.other
)
SELECT doc_id, n::BIGINT AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM sizes JOIN reach USING (doc_id) GROUP BY doc_id, n
"""

ORACLES["op2_exact_dedup"] = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256({LOWER.format("coalesce(text, '')")}) AS h FROM documents)
WINDOW same AS (PARTITION BY h)
"""

RULED = """
SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
FROM (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
        THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
)
"""


def _kappa(groups: str, prior: str) -> str:
    noise = f"{prior} * (1 - {prior})"
    rho = f"sum(pow(good - n * {prior}, 2) - n * {noise}) / nullif(sum(n * (n - 1) * {noise}), 0)"
    return f"""(SELECT CASE WHEN coalesce(rho, 0) <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, (1 - rho) / rho)) END
        FROM (SELECT {rho} AS rho FROM {groups}))"""


ORACLES["op5_url_filter"] = f"""
WITH urls AS ({RULED}
), hosts AS (
    SELECT host, count(quality)::DOUBLE AS n, coalesce(sum(quality), 0)::DOUBLE AS good,
        regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS domain, regexp_extract(host, '[^.]\\.([^.]+)$', 1) AS suffix
    FROM urls LEFT JOIN labels ON page_id = doc_id GROUP BY host
), top AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS prior FROM hosts
), suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(prior) AS prior FROM hosts, top GROUP BY suffix
), suffix_means AS (
    SELECT suffix, (good + k * prior) / (n + k) AS mean FROM suffixes, (SELECT {_kappa("suffixes", "prior")} AS k)
), domains AS (
    SELECT domain, sum(n) AS n, sum(good) AS good, any_value(mean) AS prior
    FROM hosts JOIN suffix_means USING (suffix) GROUP BY domain
), domain_means AS (
    SELECT domain, (good + k * prior) / (n + k) AS mean FROM domains, (SELECT {_kappa("domains", "prior")} AS k)
), ready AS (SELECT host, n, good, mean AS prior FROM hosts JOIN domain_means USING (domain)
), host_means AS (
    SELECT host, (good + k * prior) / (n + k) AS mean, n + k AS weight FROM ready, (SELECT {_kappa("ready", "prior")} AS k)
)
SELECT page_id, host, path, rule,
    CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow'
        WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN bound < 0.5 THEN 'block' ELSE 'allow' END END AS verdict,
    round(bound, 6) AS score
FROM urls JOIN (SELECT host, mean + sqrt(mean * (1 - mean) / (weight + 1)) AS bound FROM host_means) USING (host)
"""

ORACLES["op10_decontamination"] = """
WITH texts AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    UNION ALL
    SELECT 'b', item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') FROM benchmark
), sets AS (
    SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g
    FROM texts
), items AS (SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n_shingles FROM sets WHERE kind = 'b'
)
SELECT d.id AS doc_id, item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles
FROM items JOIN sets d ON d.kind = 'd' AND d.g = items.g
GROUP BY d.id, item_id HAVING count(*) * 100 >= any_value(n_shingles) * 80
"""

ORACLES["op4_suffix_dedup"] = """
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw, octet_length(encode(coalesce(text, ''))) AS n
    FROM documents
), windows AS (
    SELECT r, s, md5(raw[s + 1:s + 400]) AS h FROM (SELECT r, raw, unnest(range(n - 399)) AS s FROM texts WHERE n >= 400)
), hits AS (SELECT r, s FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), steps AS (
    SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 400 THEN 0 ELSE 1 END AS fresh FROM hits
), spans AS (
    SELECT r, min(s) AS a, max(s) + 400 AS e
    FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS g FROM steps) GROUP BY r, g
), sums AS (SELECT r, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r
), gaps AS (
    SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS e FROM spans
    UNION ALL SELECT r, max(e), (SELECT n FROM texts t WHERE t.r = spans.r) FROM spans GROUP BY r
), kept AS (
    SELECT r, sha256(unhex(string_agg(hex(raw[a + 1:e]), '' ORDER BY a))) AS h FROM gaps JOIN texts USING (r) WHERE e > a GROUP BY r
), spoken AS (
    SELECT row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), runs AS (
    SELECT r, k, md5(array_to_string(w[k:k + 50], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 49)) AS k FROM spoken)
), said AS (
    SELECT r, k FROM runs WHERE h IN (SELECT h FROM runs GROUP BY h HAVING count(DISTINCT r) > 1)
), marks AS (
    SELECT r, k, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + 51 THEN 0 ELSE 1 END AS fresh FROM said
), parts AS (
    SELECT r, max(k) + 51 - min(k) AS n FROM (SELECT r, k, sum(fresh) OVER (PARTITION BY r ORDER BY k) AS g FROM marks) GROUP BY r, g
), talk AS (SELECT r, sum(n)::BIGINT AS n_repeated_words, count(*) AS n_repeated_runs FROM parts GROUP BY r
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    CASE WHEN n_removed = n THEN sha256('') WHEN n_removed > 0 THEN h ELSE sha256(raw) END AS kept_sha256,
    coalesce(n_repeated_words, 0) AS n_repeated_words, coalesce(n_repeated_runs, 0) AS n_repeated_runs, n_repeated_words IS NOT NULL AS repeats
FROM texts LEFT JOIN sums USING (r) LEFT JOIN kept USING (r) LEFT JOIN talk USING (r)
"""


def _crc32(text: str) -> str:
    bit = "xor(b >> 1, 3988292384 * (b & 1))"
    byte = f"list_reduce(range(8), lambda b, k: {bit}, xor(c, x))"
    letters = f"list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce({letters}, lambda c, x: {byte}, 4294967295), 4294967295)"


def _add(state: str, cost: str, letter: str) -> str:
    """A cost of eight digits and the audit, as one string in the order of both."""
    return f"(lpad((left({state}, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({state}, 9) || '{letter}')"


def _least(*options: str) -> str:
    return f"least({', '.join(options)})"


def _may(condition: str, then: str) -> str:
    return f"CASE WHEN {condition} THEN {then} END"


_KEEP = {k: {x: _may(f"NOT dead AND i = '{x}'", _add(f"c{k}", "late", "K")) for x in "sua"} for k in range(4)}
_REROLE = {k: _may("NOT dead", _add(f"c{k}", "2 + late", "R")) for k in range(4)}
_GONE = {k: _add(f"c{k}", "3", "D") for k in range(4)}
ORACLES["op11_repair"] = f"""
WITH RECURSIVE places AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place
    FROM conversations
), faults AS (SELECT *, {_crc32("place")} % 20 AS fault FROM places
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM faults
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
        left(role, 1) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM damaged
), marked AS (
    SELECT *, ending = '' AS blank, ending <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again FROM placed
), flagged AS (
    SELECT *, blank OR again AS dead, (NOT blank AND NOT again AND ending NOT IN ('.', '!', '?'))::INT AS late,
        lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM marked
), ids AS (SELECT DISTINCT conv_id FROM conversations
), closed AS (
    SELECT conv_id, 0::BIGINT AS n, '00000000' AS c0, NULL::VARCHAR AS c1, '00000002I' AS c2, '00000004II' AS c3 FROM ids
    UNION ALL
    SELECT conv_id, n, c0, c1,
        {_least("c2", _add("c0", "2", "I"), _add("c1", "2", "I"), _add("c3", "2", "I"))},
        {_least("c3", _add("c2", "2", "I"), _add("c0", "4", "II"), _add("c1", "4", "II"))}
    FROM (
        SELECT p.conv_id, r.n, {_GONE[0]} AS c0,
            {_least(_GONE[1], _KEEP[0]["s"])} AS c1,
            {_least(_GONE[2], *[x for k in (0, 1, 3) for x in (_KEEP[k]["u"], _REROLE[k])])} AS c2,
            {_least(_GONE[3], _KEEP[2]["a"], _REROLE[2])} AS c3
        FROM closed p JOIN flagged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.n + 1
    )
), best AS (
    SELECT conv_id, left(b, 8)::BIGINT AS cost, substr(b, 9) AS audit
    FROM (SELECT conv_id, arg_max(least(c0, c3), n) AS b FROM closed GROUP BY conv_id)
), letters AS (
    SELECT conv_id, k, e, sum((e <> 'I')::INT) OVER w AS n, sum((e <> 'D')::INT) OVER w AS line,
        (length(audit) - length(replace(audit, 'D', ''))) AS gone, length(audit) AS total
    FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k, unnest(string_split(audit, '')) AS e FROM best WHERE audit <> '')
    WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), lines AS (
    SELECT l.conv_id, l.line, CASE WHEN e = 'K' THEN r.role WHEN (line - (total - gone) % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || CASE WHEN e = 'I' THEN '' ELSE r.text END AS said
    FROM letters l LEFT JOIN flagged r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.n = l.n AND e <> 'I' WHERE e <> 'D'
), texts AS (SELECT conv_id, sha256(string_agg(said, chr(10) ORDER BY line)) AS h FROM lines GROUP BY conv_id
), sums AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (again) AS duplicate, sum(late)::BIGINT AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM flagged GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, coalesce(h, sha256('')) AS repaired_sha256
FROM best b LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""

ORACLES["op13_prefix_trie"] = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
    SELECT ids.conv_id, 0 AS part, place, role, text FROM ids JOIN turns ON turns.conv_id = base AND place <= h
    UNION ALL
    SELECT ids.conv_id, 1, place, role, text FROM ids JOIN turns USING (conv_id) WHERE place > h
), said AS (
    SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS bytes, sha256(length(role) || ':' || role || text) AS t
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
), paths AS (
    SELECT conv_id, depth, bytes, sha256(string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node,
        max(depth) OVER (PARTITION BY conv_id) AS length
    FROM said
    UNION ALL
    SELECT conv_id, 0, 0, '', coalesce((SELECT max(depth) FROM said WHERE said.conv_id = ids.conv_id), 0) FROM ids
), nodes AS (
    SELECT node, any_value(depth) AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
    FROM paths GROUP BY node
), links AS (
    SELECT n.*, u.node AS above, u.conv_id AS parent_conv_id
    FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes u ON u.node = p.node
), counted AS (
    SELECT l.*, coalesce(c.n, 0) AS n_children FROM links l
    LEFT JOIN (SELECT above, count(*) AS n FROM links WHERE above IS NOT NULL GROUP BY above) c ON c.above = l.node
), sums AS (
    SELECT p.node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * c.bytes)::BIGINT AS saved_tokens
    FROM counted c JOIN paths p ON p.conv_id = c.conv_id AND p.depth <= c.depth GROUP BY p.node
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM counted JOIN sums USING (node)
"""
