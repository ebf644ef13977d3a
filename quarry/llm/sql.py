"""DuckDB SQL for the queries that SQL can express, stated independently of the operators."""

#: A window is removed if its words also start earlier.
SUBSTRING = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM ranked WHERE nth > 1),
word AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT word.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY word.i) FILTER (WHERE gone.i IS NULL) AS text
         FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

#: A place is deleted if the pair of lines that begins there, or one line before, begins earlier somewhere too, or if its line
#: has 20 words or more and stands earlier too.
LINES = r"""
WITH units AS (
  SELECT doc_id, text, unnest(generate_series(0, len(u) - 1)) AS pos, unnest(u) AS unit, u
  FROM (SELECT doc_id, text, string_split_regex(regexp_replace(coalesce(text, ''),
               '\n([\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])', chr(1) || '\1', 'g'), chr(1)) AS u FROM documents)),
lines AS (SELECT doc_id, pos, rtrim(unit, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM units),
real AS (SELECT * FROM lines WHERE line <> ''),
pairs AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM real),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, pos) AS nth
           FROM pairs WHERE after IS NOT NULL),
long AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM real
         WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 20),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1]) AS pos FROM ranked WHERE nth > 1
         UNION SELECT doc_id, pos FROM long WHERE nth > 1),
per_doc AS (SELECT d.doc_id, count(r.pos) AS n_lines, count(g.pos) AS n_removed
            FROM documents d LEFT JOIN real r USING (doc_id) LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.pos = r.pos
            GROUP BY d.doc_id),
kept AS (SELECT u.doc_id, string_agg(u.unit, chr(10) ORDER BY u.pos) AS kept_text
         FROM units u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.pos = u.pos WHERE g.pos IS NULL GROUP BY u.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM per_doc LEFT JOIN kept USING (doc_id)
"""

#: The base measures, logarithmic buckets, their quartiles by group, and the fences around them.
QUALITY = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS solid FROM documents),
five AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 4)) AS i, ws FROM t WHERE len(ws) >= 5),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 4], ' ')) AS n FROM five),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM again WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
base AS (SELECT t.doc_id, lang, source, len(ws) AS n_words, length(solid) AS word_chars,
                length(regexp_replace(solid, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
                len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
                length(regexp_replace(solid, '[^\p{L}\p{M}]', '', 'g')) AS n_letters,
                length(regexp_replace(solid, '[^\p{Lu}]', '', 'g')) AS n_upper
         FROM t JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
measures AS (
  SELECT doc_id, lang, source, base_failed, n_words, unnest([
    {'m': 'symbol_share', 'x': CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END, 'least': 0.01, 'high': true},
    {'m': 'nonletter_share', 'x': CASE WHEN word_chars > 0 THEN (word_chars - n_letters) / word_chars ELSE 0.0 END, 'least': 0.03, 'high': true},
    {'m': 'upper_share', 'x': CASE WHEN n_letters > 0 THEN n_upper / n_letters ELSE 0.0 END, 'least': 0.02, 'high': true},
    {'m': 'dup_line_share', 'x': CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END, 'least': 0.05, 'high': true},
    {'m': 'repeat_share', 'x': CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END, 'least': 0.04, 'high': true},
    {'m': 'word_length', 'x': CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END, 'least': 0.4, 'high': false}]) AS v FROM judged),
flat AS (SELECT doc_id, lang, source, base_failed, n_words, v.m, CAST(v.x AS DOUBLE) AS x, CAST(v.least AS DOUBLE) AS least, v.high,
                CAST(round(ln(1 + CAST(v.x AS DOUBLE) / 0.001) / ln(1.02::DOUBLE)) AS INTEGER) AS bucket FROM measures),
sketch AS (SELECT lang, source, m, bucket, count(*) AS n FROM flat WHERE NOT base_failed GROUP BY ALL),
by_group AS (
  SELECT 0 AS level, lang, source, m, bucket, n FROM sketch
  UNION ALL SELECT 1, lang, NULL, m, bucket, sum(n) FROM sketch GROUP BY lang, m, bucket
  UNION ALL SELECT 2, NULL, NULL, m, bucket, sum(n) FROM sketch GROUP BY m, bucket),
cum AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY level, lang, source, m) AS total FROM by_group),
quart AS (SELECT level, lang, source, m, max(total) AS total,
                 (exp(min(bucket) FILTER (WHERE c >= 0.25 * total) * ln(1.02::DOUBLE)) - 1) * 0.001 AS q1,
                 (exp(min(bucket) FILTER (WHERE c >= 0.75 * total) * ln(1.02::DOUBLE)) - 1) * 0.001 AS q3
          FROM cum GROUP BY level, lang, source, m),
verdict AS (
  SELECT f.doc_id, bool_and(q.q1 IS NULL OR (
           f.x <= q.q3 + 4.0 * greatest(q.q3 - q.q1, f.least) + f.least * sqrt(40.0 / greatest(f.n_words, 1))
           AND (f.high OR f.x >= q.q1 - 4.0 * greatest(q.q3 - q.q1, f.least) - f.least * sqrt(40.0 / greatest(f.n_words, 1))))) AS inside
  FROM flat f
  LEFT JOIN quart o ON o.level = 0 AND o.lang IS NOT DISTINCT FROM f.lang AND o.source IS NOT DISTINCT FROM f.source AND o.m = f.m
  LEFT JOIN quart l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM f.lang AND l.m = f.m
  LEFT JOIN quart w ON w.level = 2 AND w.m = f.m
  LEFT JOIN LATERAL (SELECT CASE WHEN o.total IS NULL THEN NULL WHEN o.total >= 50 THEN o.q1 WHEN l.total >= 50 THEN l.q1 ELSE w.q1 END AS q1,
                            CASE WHEN o.total IS NULL THEN NULL WHEN o.total >= 50 THEN o.q3 WHEN l.total >= 50 THEN l.q3 ELSE w.q3 END AS q3) q ON true
  GROUP BY f.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept
FROM judged JOIN verdict USING (doc_id)
"""


def _merkle(levels: int = 7) -> str:
    """Trees of up to 16 ** levels leaves: every level's digests, siblings before and after, and the fold along them."""
    def field(c: str) -> str:
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    crc = ("xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)), "
           "lambda a, b: list_reduce([xor(a, b), 1, 1, 1, 1, 1, 1, 1, 1]::UBIGINT[], "
           "lambda x, k: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)")
    ctes = [f"""base AS (SELECT doc_id, source, {leaf('text')} AS leaf,
              CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(f"translate(text, '{upper}', '{lower}')")} END AS altered FROM documents)""",
            """d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
              count(*) OVER (PARTITION BY source) AS n FROM base)""",
            """s0 AS (SELECT source, i, n, leaf AS h FROM d)"""]
    for k in range(levels):
        over = ("OVER (PARTITION BY source, i // 16 ORDER BY i ROWS BETWEEN {})")
        ctes += [f"""p{k} AS (SELECT source, i, n > 1 AS up,
                   coalesce(string_agg(h, '') {over.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS before,
                   coalesce(string_agg(h, '') {over.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS after FROM s{k})""",
                 f"""s{k + 1} AS (SELECT source, i // 16 AS i, (n + 15) // 16 AS n,
                   CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM s{k} GROUP BY source, i // 16, n)"""]
    ctes.append(f"t0 AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM s{levels})")
    for k in range(levels):
        over = ("OVER (PARTITION BY i // 16 ORDER BY i ROWS BETWEEN {})")
        ctes += [f"""q{k} AS (SELECT i, n > 1 AS up,
                   coalesce(string_agg(h, '') {over.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS before,
                   coalesce(string_agg(h, '') {over.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS after FROM t{k})""",
                 f"""t{k + 1} AS (SELECT i // 16 AS i, (n + 15) // 16 AS n,
                   CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM t{k} GROUP BY i // 16, n)"""]
    ctes.append(f"""f0 AS (SELECT d.doc_id, d.source, d.i, d.leaf, s.h AS subroot, t0.i AS ti, (SELECT h FROM t{levels}) AS root,
                   coalesce(d.altered, d.leaf) AS h, '' AS proof
                   FROM d JOIN s{levels} s ON s.source IS NOT DISTINCT FROM d.source JOIN t0 ON t0.source IS NOT DISTINCT FROM d.source)""")
    for k in range(levels):
        ctes.append(f"""f{k + 1} AS (SELECT f.* EXCLUDE (h, proof, i), f.i // 16 AS i,
                   CASE WHEN p.up THEN sha256(before || h || after) ELSE h END AS h, proof || CASE WHEN p.up THEN before || after ELSE '' END AS proof
                   FROM f{k} f JOIN p{k} p ON p.source IS NOT DISTINCT FROM f.source AND p.i = f.i)""")
    for k in range(levels):
        ctes.append(f"""g{k + 1} AS (SELECT f.* EXCLUDE (h, proof, ti), f.ti // 16 AS ti,
                   CASE WHEN p.up THEN sha256(before || h || after) ELSE h END AS h, proof || CASE WHEN p.up THEN before || after ELSE '' END AS proof
                   FROM {f'g{k}' if k else f'f{levels}'} f JOIN q{k} p ON p.i = f.ti)""")
    return ("WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM g{levels}""")


#: The digests of every level, and each row folded along its siblings.
MERKLE = _merkle()

#: The longest listed rule; else any set of url tokens of enough support and confidence among labelled pages blocks.
URLS = r"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS cut FROM pages),
b AS (SELECT page_id, u, CASE WHEN cut > 0 THEN substr(u, cut + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, u, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM b),
d AS (SELECT page_id, u, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM c),
rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(verdict, name, start)),
e AS (SELECT d.*, (SELECT max({'n': length(name || start), 'rule': name || start, 'verdict': verdict}) FROM rules
                   WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)) AS best,
             array_to_string(list_sort(list_distinct(list_transform(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'),
                                                                    lambda x: split_part(x, '=', 1)))), '&') AS names FROM d),
f AS (SELECT page_id, host, path, best, CASE WHEN host = '' THEN [] ELSE list_filter([
        'scheme:' || lower(split_part(u, '://', 1)), 'host:' || host, 'domain:' || regexp_extract(host, '(?s)^[^.]*\.(.+)\z', 1),
        'name:' || regexp_extract(host, '^([^.]*)\.', 1), 'dir:' || regexp_replace(regexp_extract(path, '(?s)^.*/'), '[0-9]+', '0', 'g'),
        'ext:' || regexp_extract(path, '\.([^./]*)\z', 1), 'query:' || names,
        'fragment:' || CASE WHEN contains(u, '#') THEN 'yes' ELSE '' END], lambda x: NOT regexp_matches(x, '^[a-z]+:\z')) END AS items FROM e),
bad AS (SELECT doc_id, bool_or(coalesce(toxic = 1, false) OR coalesce(quality = 0, false)) AS bad FROM labels
        WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
known AS (SELECT list_sort(items) AS items, bad FROM f JOIN bad ON doc_id = page_id WHERE len(items) > 0),
sets AS (SELECT items, bad, unnest(generate_series(1, (1 << len(items)) - 1)) AS mask FROM known),
mined AS (SELECT list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS s, count(*) AS n, count(*) FILTER (bad) AS b FROM sets GROUP BY 1
          HAVING b >= 25 AND b >= 0.001::DOUBLE * (SELECT count(*) FROM known) AND b >= 0.5::DOUBLE * n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN EXISTS (SELECT 1 FROM mined WHERE list_has_all(items, s))
       THEN 'block' ELSE 'allow' END) AS verdict FROM f
"""
