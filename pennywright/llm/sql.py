"""DuckDB SQL that gives the rows of the queries."""

#: CTEs with the quality statistics of the rows of a relation {docs}, by row number `rid`.
QUALITY_STATS = r"""
qtext AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {docs}),
qwords AS (
  SELECT rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(t, chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM qtext),
qgrams AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM qwords WHERE len(ws) >= 3)),
qagain AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM qgrams)
  WHERE n >= 2),
qcovered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM qagain) GROUP BY rid),
qstats AS (
  SELECT q.*, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM qtext q JOIN qwords USING (rid) LEFT JOIN qcovered USING (rid)),
qjudged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
              OR word_chars < 3 * n_words OR word_chars > 10 * n_words
              OR 100 * n_dup_lines > 50 * n_lines) AS kept
  FROM qstats)"""

QUALITY_RULES = "WITH " + QUALITY_STATS.format(docs="documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
FROM qjudged"""


def mixing(docs: str, fraction: tuple[int, int], epochs: int, seed: str) -> str:
    """CTEs that end in mtaken: rows of a relation (doc_id, text, lang, source, ...) by epoch.

    Written for tables with at least one row per leaf; budgets follow the same whole-number rule.
    """
    def level(name, path, parent):
        keys = ", ".join(path)
        up = " AND ".join(f"k.{c} IS NOT DISTINCT FROM u.{c}" for c in parent)
        budget = (f"JOIN m{parent[-1]} u ON {up}" if parent else
                  f", (SELECT least((sum(tokens) * {fraction[0]}) // {fraction[1]}, "
                  f"sum(tokens) * {epochs}) AS got FROM mleaf) u")
        by = f"PARTITION BY {', '.join(f'{c}' for c in parent)}" if parent else ""
        weight = "CASE WHEN lang = 'en' THEN 3 ELSE 2 END" if name == "lang" else "1"
        cols = ", ".join(f"k.{c}" for c in path)
        return f"""
m{name}0 AS (
  SELECT {cols}, k.tokens, k.tokens * {epochs} AS cap, {weight.replace('lang', 'k.lang')} AS w,
         u.got AS budget
  FROM (SELECT {keys}, sum(n_tokens) AS tokens FROM mrows GROUP BY {keys}) k {budget}),
m{name}1 AS (
  SELECT *, budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS rest,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened,
         row_number() OVER o AS rn
  FROM m{name}0 WINDOW o AS ({by} ORDER BY cap / w, {keys})),
m{name}2 AS (
  SELECT *, min(CASE WHEN cap * opened > rest * w THEN rn END) OVER ({by}) AS first_open
  FROM m{name}1),
m{name} AS (
  SELECT *, CASE WHEN first_open IS NULL OR rn < first_open THEN cap
    ELSE (max(CASE WHEN rn = first_open THEN rest END) OVER ({by}) * w)
         // max(CASE WHEN rn = first_open THEN opened END) OVER ({by}) END AS got
  FROM m{name}2),"""
    return f"""
mrows AS (
  SELECT *, coalesce('domain' || (CAST(nullif(regexp_extract(coalesce(source, ''),
           '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 4), 'other') AS domain,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                         lambda x: x <> ''))::BIGINT AS n_tokens
  FROM {docs}),
mleaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM mrows GROUP BY ALL),
{level('domain', ['domain'], [])}{level('lang', ['domain', 'lang'], ['domain'])}{
    level('source', ['domain', 'lang', 'source'], ['domain', 'lang'])}
mepochs AS (
  SELECT r.*, e AS epoch, md5('{seed}:' || e || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mh
  FROM mrows r, (SELECT unnest(range(1, {epochs + 1})) AS e)),
mtaken AS (
  SELECT * FROM (
    SELECT m.*, least(s.got - (epoch - 1) * s.tokens, s.tokens) AS room,
           sum(n_tokens) OVER (PARTITION BY m.domain, m.lang, m.source, epoch ORDER BY mh) AS used
    FROM mepochs m JOIN msource s ON m.domain = s.domain AND m.lang IS NOT DISTINCT FROM s.lang
         AND m.source IS NOT DISTINCT FROM s.source)
  WHERE room > 0 AND used <= room)"""


MIXING = "WITH " + mixing("documents", (1, 2), 2, "mix-1") + """
SELECT doc_id, domain, lang, source, n_tokens, epoch::INT AS epoch FROM mtaken"""


def ngram_groups(docs: str, n: int, num: int, den: int) -> str:
    """CTEs (of a WITH RECURSIVE) that end in jgroups: doc_id, n_shingles, component_id."""
    grams = " || ' ' || ".join(f"ws[i + {k}]" for k in range(n))
    return f"""
jwords AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda w: w <> '') AS ws FROM {docs}),
jshingles AS (
  SELECT DISTINCT doc_id, {grams} AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM jwords WHERE len(ws) >= {n})
  UNION ALL
  SELECT doc_id, array_to_string(ws, ' ') FROM jwords WHERE len(ws) BETWEEN 1 AND {n - 1}),
jsizes AS (SELECT doc_id, count(*) AS n FROM jshingles GROUP BY doc_id),
jpairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM jshingles a JOIN jshingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
jlinks AS (
  SELECT a, b FROM jpairs JOIN jsizes x ON a = x.doc_id JOIN jsizes y ON b = y.doc_id
  WHERE {den} * c >= {num} * (x.n + y.n - c)),
jreach AS (
  SELECT doc_id AS src, doc_id AS dst FROM {docs}
  UNION SELECT r.src, l.b FROM jreach r JOIN jlinks l ON r.dst = l.a),
jgroups AS (
  SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
  FROM {docs} d LEFT JOIN jsizes s ON d.doc_id = s.doc_id
  JOIN (SELECT src, min(dst) AS component_id FROM jreach GROUP BY src) r ON r.src = d.doc_id)"""


NGRAM_JOIN = "WITH RECURSIVE " + ngram_groups("documents", 3, 90, 100) + """
SELECT * FROM jgroups"""


FILTER_AUDIT = r"""WITH
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         min(doc_id) OVER (PARTITION BY t) AS first_id
  FROM texts),
judged AS (
  SELECT part, doc_id,
         CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN first_id < doc_id THEN 16 ELSE 0 END AS fails
  FROM words),
known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
sets AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM judged LEFT JOIN known USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, s.step::INTEGER AS step, bits[s.step] AS bit,
         coalesce(list_sum(bits[1:s.step - 1]), 0)::INTEGER AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN fails & (earlier + bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails & bit > 0 AND fails & earlier = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails & bit > 0 AND fails & earlier > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails & bit > 0 AND fails & earlier = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails & bit > 0 AND fails & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM sets, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted"""


def _code_round(i: int) -> str:
    """CTEs of one assignment (near{i}) under codebook {i}; a distance and an index in one number."""
    return f"""
near{i} AS (
  SELECT rid, v.part, min(list_sum(list_transform(list_zip(v.x, b.x),
           lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + entry) AS packed
  FROM pieces v JOIN book{i} b ON v.part = b.part GROUP BY rid, v.part),
code{i} AS (SELECT rid, part, (packed % 64)::INTEGER AS entry, (packed // 64)::BIGINT AS error FROM near{i})"""


def _code_update(i: int) -> str:
    return f"""
mean{i} AS (
  SELECT part, entry, place, floor(sum(value)::DOUBLE / count(*))::BIGINT AS value
  FROM (SELECT c.part, c.entry, unnest(range(len(v.x))) AS place, unnest(v.x) AS value
        FROM code{i} c JOIN pieces v ON c.rid = v.rid AND c.part = v.part) GROUP BY ALL),
fresh{i} AS (SELECT part, entry, list(value ORDER BY place) AS x FROM mean{i} GROUP BY part, entry),
book{i + 1} AS (
  SELECT b.part, b.entry, coalesce(f.x, b.x) AS x
  FROM book{i} b LEFT JOIN fresh{i} f ON b.part = f.part AND b.entry = f.entry)"""


VECTOR_CODES = f"""WITH
vectors AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (
  SELECT rid, vec_id, p.part, q[p.part * (len(q) // 16) + 1 : (p.part + 1) * (len(q) // 16)] AS x
  FROM vectors, (SELECT unnest(range(16)) AS part) p),
book0 AS (SELECT part, rid - 1 AS entry, x FROM pieces WHERE rid <= 64),
{_code_round(0)}, {_code_update(0)}, {_code_round(1)}, {_code_update(1)}, {_code_round(2)},
coded AS (
  SELECT rid, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(error)::BIGINT AS error
  FROM code2 GROUP BY rid),
numbers AS (
  SELECT part, entry, unnest(range(len(x))) AS place, unnest(x) AS value FROM book2),
books AS (SELECT sha256(string_agg(value::VARCHAR, ',' ORDER BY part, entry, place)) AS h FROM numbers)
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       h AS codebooks_sha256
FROM coded JOIN vectors USING (rid), books"""
