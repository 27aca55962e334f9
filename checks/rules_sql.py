"""SQL text of the rule lists, for comparison."""

from pennywright.functions import fixed_values as fv


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def contains_case(text: str, groups: dict, otherwise: str = "NULL") -> str:
    whens = []
    for name, words in groups.items():
        test = " OR ".join(f"contains({text}, {quoted(w)})" for w in words)
        whens.append(f"WHEN {test} THEN {quoted(name)}")
    return f"CASE {' '.join(whens)} ELSE {otherwise} END"


def regex_case(text: str, rules: dict, otherwise: str = "NULL") -> str:
    whens = [f"WHEN regexp_matches({text}, {quoted(p)}) THEN {quoted(v)}"
             for p, v in rules.items()]
    return f"CASE {' '.join(whens)} ELSE {otherwise} END"


def cleaned(text: str, patterns, flag: str) -> str:
    for p in patterns:
        text = f"regexp_replace({text}, {quoted(p)}, ' ', '{flag}')"
    return f"trim({text})"


def clean_card(text: str) -> str:
    return cleaned(f"upper({text})", fv.CARD_NOISE, "gi")


def clean_bank_stripped(text: str) -> str:
    return cleaned(text, fv.BANK_NOISE, "g")


def title(text: str) -> str:
    """Capital after every non-letter."""
    return (f"list_reduce(list_transform(regexp_extract_all({text}, '[A-Za-z]+|[^A-Za-z]+'), "
            "lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || b)")


def clean_bank(text: str) -> str:
    bare = clean_bank_stripped(text)
    return (f"CASE WHEN regexp_matches({bare}, '[A-Z]') <> regexp_matches({bare}, '[a-z]') "
            f"THEN {title(bare)} ELSE {bare} END")


def line_merchant(text: str) -> str:
    bare = (f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '#\\d+', "
            "'', 'g'), '\\s+\\d{4,}', '', 'g'), '\\bDBA\\b.*', '', 'gi'), '\\s{2,}', ' ', 'g'))")
    fallback = f"{title(f'CASE WHEN {bare} <> {quoted(str())} THEN {bare} ELSE {text} END')}"
    return regex_case(f"upper({text})", fv.LINE_MERCHANTS, fallback)


def alias_groups() -> dict:
    return {n: [a.upper() for a in words] for n, words in fv.MERCHANT_ALIASES.items()}


def taxonomy_values() -> str:
    from pennywright.operators.enrich import taxonomy_pairs
    return ", ".join(f"({quoted(m)}, {quoted(c)}, {quoted(s)})"
                     for m, (c, s) in taxonomy_pairs().items())


def fuzzy_pairs() -> list[tuple[str, str]]:
    from pennywright.operators.enrich import fuzzy_list
    return fuzzy_list()


def best_aliases(texts: str, found: str) -> str:
    """CTEs that end in `found` (s, name, score): the first best alias of each text of `texts` (s).

    Every window of the longer string is scored against the shorter one; the longest common
    subsequence comes from bit masks of the shorter one's letters, a step per letter.
    """
    aliases = ", ".join(f"({i}, {quoted(a)}, {quoted(n)})" for i, (a, n) in enumerate(fuzzy_pairs()))
    return f"""
{found}_aliases(position, alias, name) AS (VALUES {aliases}),
{found}_letters AS (
  SELECT s, ch, sum(1::BIGINT << (i - 1)::BIGINT)::BIGINT AS mask FROM (
    SELECT s, unnest(string_split(s, '')) AS ch, unnest(range(1, length(s) + 1)) AS i FROM (
      SELECT s FROM {texts} WHERE s <> '' AND length(s) < 60 UNION SELECT alias FROM {found}_aliases))
  GROUP BY s, ch),
{found}_masks AS (SELECT s, map(list(ch), list(mask)) AS masks FROM {found}_letters GROUP BY s),
{found}_sides AS (
  SELECT s, position, CASE WHEN length(s) <= length(alias) THEN s ELSE alias END AS short,
         CASE WHEN length(s) <= length(alias) THEN alias ELSE s END AS long
  FROM {texts}, {found}_aliases WHERE s <> ''
  UNION ALL
  SELECT s, position, alias, s FROM {texts}, {found}_aliases WHERE length(s) = length(alias)),
{found}_ends AS (
  SELECT *, length(short)::INTEGER AS m, unnest(range(1, length(long) + length(short))) AS stop
  FROM {found}_sides),
{found}_windows AS (
  SELECT e.s, position, m, (1::BIGINT << m::BIGINT) - 1 AS whole, masks,
         string_split(long[greatest(0, stop - m) + 1 : least(stop, length(long))], '') AS w
  FROM {found}_ends e JOIN {found}_masks k ON k.s = e.short),
{found}_scores AS (
  SELECT s, position, max(200::DOUBLE * bit_count(xor(whole, list_reduce(
           list_prepend(whole, list_transform(w, lambda ch: coalesce(masks[ch], 0::BIGINT))),
           lambda a, x: ((a + (a & x)) | (a - (a & x))) & whole))) / (m + len(w))) AS score
  FROM {found}_windows GROUP BY s, position),
{found} AS (
  SELECT s, name, score FROM {found}_scores JOIN {found}_aliases USING (position)
  WHERE score >= 75 - 1e-9
  QUALIFY row_number() OVER (PARTITION BY s ORDER BY score DESC, position) = 1)"""


def merchant_hint(raw: str) -> str:
    return f"""coalesce(nullif(array_to_string(list_filter(list_transform(
  string_split_regex(trim({raw}), '\\s+'),
  lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')),
  lambda w: length(w) > 1 AND NOT regexp_matches(
    w, '^\\d{{4,}}$|^\\d{{3}}-\\d{{3}}-\\d{{4}}$|^[A-Z]{{2}}$'))[1:3], ' '), ''), {raw}[1:20])"""


def first_word(cleaned: str, raw: str) -> str:
    words = f"list_filter(string_split_regex({cleaned}, '\\s+'), lambda w: length(w) > 2)"
    return f"CASE WHEN len({words}) > 0 THEN {title(f'{words}[1]')} ELSE trim({raw}[1:20]) END"


def resolved_merchants(rows: str) -> str:
    """CTEs that end in `resolved` from a relation of (id, description): cleaned text, merchant, score, method."""
    return f"""
worded AS (SELECT id, coalesce(description, '') AS raw FROM {rows}),
cleaned AS (SELECT *, {clean_card('raw')} AS cleaned, {merchant_hint('raw')} AS hint FROM worded),
known AS (SELECT *, {contains_case('cleaned', alias_groups())} AS exact FROM cleaned),
texts AS (SELECT DISTINCT cleaned AS s FROM known WHERE exact IS NULL),
{best_aliases('texts', 'by_text')},
hints AS (SELECT DISTINCT upper(trim(hint)) AS s FROM known LEFT JOIN by_text t ON cleaned = t.s
          WHERE exact IS NULL AND t.s IS NULL),
{best_aliases('hints', 'by_hint')},
resolved AS (
  SELECT id, raw, cleaned, coalesce(exact, t.name, h.name, CASE WHEN length(trim(hint)) > 2
           THEN {title('trim(hint)')} ELSE {first_word('cleaned', 'raw')} END) AS merchant_name,
         CASE WHEN exact IS NOT NULL THEN 1.0::DOUBLE WHEN t.s IS NOT NULL THEN t.score / 100
           WHEN h.s IS NOT NULL THEN least(h.score / 100, 0.85::DOUBLE) ELSE 0.3::DOUBLE END AS merchant_score,
         CASE WHEN exact IS NOT NULL THEN 'substring' WHEN t.s IS NOT NULL THEN 'fuzzy'
           WHEN h.s IS NOT NULL THEN 'hint' ELSE 'fallback' END AS method
  FROM known LEFT JOIN by_text t ON exact IS NULL AND cleaned = t.s
  LEFT JOIN by_hint h ON exact IS NULL AND t.s IS NULL AND upper(trim(hint)) = h.s)"""


def location(raw: str) -> str:
    places = "|".join(fv.PLACE_NAMES)
    shown = title(f"lower(regexp_extract(upper({raw}), '\\b({places})\\b', 1))")
    states = ", ".join(quoted(x) for x in fv.US_STATES)
    city = (f"CASE WHEN regexp_matches(upper({raw}), '\\b({places})\\b') THEN {shown} END")
    state = (f"CASE WHEN right(upper({raw}), 2) IN ({states}) AND NOT regexp_matches("
             f"right(upper({raw}), 3)[1:1], '\\w') THEN right(upper({raw}), 2) END")
    return f"nullif(concat_ws(', ', {city}, {state}), '')"
