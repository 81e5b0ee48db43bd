"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"[^\x20\x09-\x0D]+"

_MIXING = f"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0) AS BIGINT) AS size FROM documents
), sums AS (
    SELECT source, sum(size) AS source_size, 2.0 * sum(size) AS most FROM sized GROUP BY source
), weighed AS (
    SELECT *, CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS DOUBLE) AS weight FROM sums
), ordered AS (
    SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(most) OVER filled, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER filled, 0)) AS level
    FROM weighed WINDOW filled AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
    SELECT source, source_size, CAST(least(most, max(level) OVER () * weight) AS DOUBLE) AS target FROM ordered
), planned AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM goals
), placed AS (
    SELECT s.doc_id, s.size, p.source_size, p.target, p.passes, round(p.target - p.passes * p.source_size) AS rest,
        sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || s.doc_id), s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
    FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
    CAST(passes * size + greatest(least(rest - before, size), 0) AS BIGINT) AS taken
FROM placed
"""

_WARC = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages), sized AS (
    SELECT *, strlen(html) AS payload_bytes, CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS response FROM payloads
)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
    CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN response <> page_id THEN response END AS refers_to
FROM sized
"""


_NEAR = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), both_ways AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b.y FROM reached r JOIN both_ways b ON r.other = b.x
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM reached d LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


#: Bytes as pairs of hexadecimal digits; texts are cut into pieces of 1,024 bytes, as a substring far into a long text is slow.
_REPEATS = """
WITH texts AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), pieces AS (
    SELECT doc_id, n, k, substring(h, 2048 * k + 1, 2246) AS h FROM (SELECT *, unnest(range(0, n // 1024 + 1)) AS k FROM texts)
), places AS (
    SELECT doc_id, 1024 * k + j AS i, substring(h, 2 * j + 1, 2) AS byte, CASE WHEN 1024 * k + j + 100 <= n THEN substring(h, 2 * j + 1, 200) END AS s
    FROM (SELECT *, unnest(range(0, least(1024, n - 1024 * k))) AS j FROM pieces)
), judged AS (
    SELECT doc_id, i, byte, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM places
), covered AS (
    SELECT doc_id, i, byte, max(again::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) = 1 AS gone FROM judged
), runs AS (
    SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens FROM covered
), kept AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS h FROM runs GROUP BY doc_id
)
SELECT t.doc_id, t.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""


def _smoothed(k: int, side: str) -> str:
    """Witten-Bell estimate of order ``k`` for one class, from that of the order below."""
    lower = f"p{k - 1}_{side}" if k else "(1 / 256.0)"
    count, total, kinds = (f"l{k}.{c}_{side}" for c in ("n", "t", "m"))
    return f"CASE WHEN {total} > 0 THEN ({count} + {kinds} * {lower}) / ({total} + {kinds}) ELSE {lower} END AS p{k}_{side}"


def _url_filter() -> str:
    levels = "\n".join(
        f", o{k} AS (SELECT o.*, {_smoothed(k, 'a')}, {_smoothed(k, 'r')} FROM {f'o{k - 1}' if k else 'totals'} o "
        f"JOIN known l{k} ON l{k}.k = {k} AND l{k}.tail = right(o.gram, {k + 1}))"
        for k in range(5)
    )
    return f"""
WITH u AS (
    SELECT page_id, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), ruled AS (
    SELECT *, CASE
        WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
        WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
        WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM u
), judged AS (
    SELECT *, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS given,
        coalesce(left(md5(page_id::VARCHAR), 1) IN ('0', '1', '2'), FALSE) AS aside FROM ruled
), places AS (
    SELECT page_id, url, given, aside, substring(repeat(chr(2), 4) || coalesce(url, '') || chr(3), i::INTEGER, 5) AS gram
    FROM (SELECT *, unnest(range(1, length(coalesce(url, '')) + 2)) AS i FROM judged)
), totals AS (
    SELECT gram, count(*) FILTER (given = 'allow' AND NOT aside) AS a, count(*) FILTER (given = 'block' AND NOT aside) AS r FROM places GROUP BY gram
), levels AS (
    SELECT k, right(gram, k::INTEGER + 1) AS tail, a, r FROM totals, (SELECT unnest(range(0, 5)) AS k)
), seen AS (
    SELECT k, tail, left(tail, k::INTEGER) AS context, sum(a) AS n_a, sum(r) AS n_r FROM levels GROUP BY k, tail
), contexts AS (
    SELECT k, context, sum(n_a) AS t_a, sum(n_r) AS t_r, count(*) FILTER (n_a > 0) AS m_a, count(*) FILTER (n_r > 0) AS m_r FROM seen GROUP BY k, context
), known AS (
    SELECT s.k, s.tail, s.n_a, s.n_r, c.t_a, c.t_r, c.m_a, c.m_r FROM seen s JOIN contexts c USING (k, context)
){levels}, scores AS (
    SELECT gram, ln(p4_a) - ln(p4_r) AS score FROM o4
), pages_scored AS (
    SELECT page_id, url, avg(score) AS score FROM places JOIN scores USING (gram) GROUP BY page_id, url
), full_rows AS (
    SELECT j.*, p.score FROM judged j JOIN pages_scored p ON j.page_id IS NOT DISTINCT FROM p.page_id AND j.url IS NOT DISTINCT FROM p.url
), spread AS (
    SELECT avg(score) FILTER (given = 'allow') AS ma, avg(score) FILTER (given = 'block') AS mb,
        stddev_pop(score) FILTER (given = 'allow') AS sa, stddev_pop(score) FILTER (given = 'block') AS sb
    FROM (SELECT DISTINCT page_id, url, given, aside, score FROM full_rows) WHERE aside
), cut AS (
    SELECT CASE WHEN ma IS NULL OR mb IS NULL THEN '-infinity'::DOUBLE ELSE mb + coalesce(sb / nullif(sa + sb, 0), 0.5) * (ma - mb) END AS least_score FROM spread
)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN score >= least_score THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score
FROM full_rows, cut
"""


#: CRC-32 of the id's digits by its table; a node is the list of its turns, and what lies below it meets it by its first turns.
_TRIE = """
WITH entries AS (
    SELECT list(list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY n) AS entry
    FROM (SELECT unnest(range(0, 256)) AS n)
), turns AS (
    SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), originals AS (
    SELECT conv_id, list(t ORDER BY place) AS own FROM turns GROUP BY conv_id
), planned AS (
    SELECT conv_id, own, conv_id - conv_id % 5 AS lender, CAST(xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
        lambda c, d: xor(entry[1 + xor(c % 256, d)], c // 256))) % 9 AS BIGINT) AS h
    FROM originals, entries
), rebuilt AS (
    SELECT p.conv_id, coalesce(o.own, [])[1:h] || p.own[h + 1:] AS path FROM planned p LEFT JOIN originals o ON o.conv_id = p.lender
), prefixes AS (
    SELECT conv_id, path[1:depth] AS node, depth, len(path) = depth AS ends FROM (SELECT *, unnest(range(0, len(path) + 1)) AS depth FROM rebuilt)
), nodes AS (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY prefixes.conv_id) FILTER (ends), '')) AS ends_sha256
    FROM prefixes GROUP BY node, depth
), families AS (
    SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.node[1:n.depth] = n.node) AS n_children,
        CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * octet_length(encode(n.node[n.depth].text)) ELSE 0 END AS saved
    FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
), below AS (
    SELECT node[1:top] AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS top FROM families) GROUP BY 1
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM families JOIN below USING (node)
"""


_PHRASES = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3]) AS k))
), counts AS (
    SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10
), cuts AS (
    SELECT c.*, i, x.f AS l, y.f AS r, (1000000 * a::HUGEINT * a) // (x.f::HUGEINT * y.f) AS score
    FROM (SELECT *, unnest(range(1, k)) AS i FROM candidates) c
    JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:i], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[i + 1:], ' ')
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), inside AS (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM candidates WHERE k = 3
), covered AS (
    SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL
), ranked AS (
    SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, encode(c.phrase)) AS rank, c.phrase, a, l, r, score::BIGINT AS score
    FROM lowest c LEFT JOIN covered v ON v.lang = c.lang AND v.phrase = c.phrase WHERE 100 * coalesce(longer, 0) < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


ORACLES: dict[str, str] = {"op4_url_filter": _url_filter(), "op5_suffix_dedup": _REPEATS, "op7_hyperminhash": _NEAR, "op8_warc": _WARC, "op9_mixing": _MIXING, "op12_phrases": _PHRASES, "op13_prefix_trie": _TRIE}
