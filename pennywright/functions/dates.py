"""Dates of statements: every unreadable text is null, never an error."""

from pyspark.sql import Column, functions as F

from pennywright.functions import fixed_values as fv

_MON = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def _int(text: Column) -> Column:
    return text.try_cast("int")


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """Calendar date or null when the parts do not make one."""
    text = F.concat_ws(
        "-",
        F.lpad(year.cast("string"), 4, "0"),
        F.lpad(month.cast("string"), 2, "0"),
        F.lpad(day.cast("string"), 2, "0"),
    )
    whole = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(whole, text).try_cast("date")


def full_year(year: Column) -> Column:
    """Two-digit years: 00-69 are 2000s, 70-99 are 1900s."""
    return F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)


def month_number(name: Column) -> Column:
    """1-12 from a month name or its first three letters, else null."""
    short = F.lower(F.substring(name, 1, 3))
    names = F.array(*[F.lit(m[:3].lower()) for m in fv.MONTH_NAMES])
    position = F.array_position(names, short)
    return F.when(position > 0, position.cast("int"))


def full_month_number(name: Column) -> Column:
    """1-12 only for a whole, capitalised English month name."""
    names = F.array(*[F.lit(m) for m in fv.MONTH_NAMES])
    position = F.array_position(names, name)
    return F.when(position > 0, position.cast("int"))


def _rewrite(text: Column, rules) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _numeric(text: Column, first: int, second: int) -> Column:
    """Numeric spellings as yyyy-m-d with the given month and day group -> date."""
    head, tail = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.]", r"(?:\D.*)?$"
    day = f"${first}-${second}"
    text = _rewrite(text, [
        (head + r"(\d{4})" + tail, "$3-" + day),
        (head + r"([0-6]\d)" + tail, "20$3-" + day),
        (head + r"([7-9]\d)" + tail, "19$3-" + day),
    ])
    return F.regexp_extract(text, r"^\d{4}-\d{1,2}-\d{1,2}", 0).try_cast("date")


def parse_date(raw: Column) -> Column:
    """Month-first date text in the usual spellings -> date.

    yyyy-MM-dd, MM/dd/yyyy, M/d/yy, MM-dd-yyyy, yyyyMMdd, `Jan 5, 2024`,
    `5 Jan 2024`; day and month change places when the first is above 12.
    """
    text = F.trim(raw)
    words = _rewrite(text, [
        (rf"(?i)^({_MON})[a-z]*\.?\s*(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})", "$1 $2 $3"),
        (rf"(?i)^(\d{{1,2}})\s+({_MON})[a-z]*\.?,?\s+(\d{{4}})", "$2 $1 $3"),
    ])
    return F.coalesce(
        _numeric(text, 1, 2),
        _numeric(text, 2, 1),
        F.try_to_date(F.initcap(words), "MMM d yyyy"),
        F.try_to_date(text, "yyyyMMdd"),
    )


def period_date(raw: Column) -> Column:
    """`mm-dd-yy` or `mm/dd/yy` -> date."""
    pattern = r"^(\d{2})[-/](\d{2})[-/](\d{2})"
    month, day, year = (_int(F.regexp_extract(raw, pattern, i)) for i in (1, 2, 3))
    return iso_date(full_year(year), month, day)


def long_date(raw: Column) -> Column:
    """`March 7, 2026` -> date."""
    pattern = r"^(\w+)\s+(\d{1,2}),\s*(\d{4})"
    return iso_date(
        _int(F.regexp_extract(raw, pattern, 3)),
        full_month_number(F.regexp_extract(raw, pattern, 1)),
        _int(F.regexp_extract(raw, pattern, 2)),
    )


def month_day_date(raw: Column, start: Column, end: Column, default_year: int = 2025) -> Column:
    """`JAN05` with the statement period -> date.

    In a period that crosses the year end, months from the first month on
    belong to the first year.
    """
    month = month_number(F.regexp_extract(F.upper(raw), rf"^({fv.DCU_MONTHS})(\d{{2}})$", 1))
    day = _int(F.regexp_extract(raw, r"(\d{2})$", 1))
    crosses = (F.month(start) > F.month(end)) & (month >= F.month(start))
    year = F.when(crosses, F.year(start)).otherwise(
        F.coalesce(F.year(end), F.lit(default_year))
    )
    return iso_date(year, month, day)


def slash_date(raw: Column, start: Column, end: Column, default_year: int = 2026) -> Column:
    """`MM/DD` with the statement period -> date."""
    month = _int(F.regexp_extract(raw, r"^(\d{2})/(\d{2})", 1))
    day = _int(F.regexp_extract(raw, r"^(\d{2})/(\d{2})", 2))
    crosses = (F.year(start) != F.year(end)) & (month >= F.month(start))
    year = F.when(crosses, F.year(start)).otherwise(
        F.coalesce(F.year(end), F.lit(default_year))
    )
    return iso_date(year, month, day)


def year_for_month(month: Column, closing_month: Column, closing_year: Column) -> Column:
    """Months after the closing month belong to the year before."""
    return F.when(month > closing_month, closing_year - 1).otherwise(closing_year)


def billing_period(text: Column, filename: Column) -> Column:
    """struct(closing_month, closing_year) of a card statement.

    Ordered rules over the text, then the file name, then short dates in the
    text; (null, 2025) when nothing matches.
    """
    def part(column, pattern, group):
        return F.regexp_extract(column, pattern, group)

    def rule(month, year):
        return F.when(
            year.isNotNull(),
            F.struct(month.cast("int").alias("closing_month"),
                     year.cast("int").alias("closing_year")),
        )

    name = F.regexp_replace(filename, r"(?i)\.pdf$", "")
    span = (rf"(?i)(?:{_MON})[a-z]*[\s\w,\-]+({_MON})[a-z]*\s*[\s,\-]?\s*(\d{{1,2}}),?\s*"
            r"(20\d{2})")
    closing = (rf"(?i)(?:closing\s*date|statement\s*closing)[^\n]{{0,20}}?({_MON})[a-z]*"
               r"\s*(\d{1,2}),?\s*(20\d{2})")
    slashed = (r"(?i)(?:closing\s*date|statement\s*closing)[^\n]*?(\d{1,2})/(\d{1,2})/(20\d{2})")
    named = rf"(?i)({_MON})[a-z]*(20\d{{2}})"
    bare = r"(?:^|[^\d])(20\d{2})(?:[^\d]|$)"
    short = (r"(?i)billing\s*period[^\n]*?(\d{1,2})/(\d{1,2})/(\d{2})\s*[-–]\s*"
             r"(\d{1,2})/(\d{1,2})/(\d{2})")
    anywhere = r"\b\d{1,2}/\d{1,2}/(\d{2})\b"
    dated = r"(20\d{2})-(\d{2})-\d{2}"
    # how both ends of `span` and `closing` read; found without trying every way to reach it
    end = rf"(?i)(?:{_MON})[a-z]*\s*[\s,\-]?\s*\d{{1,2}},?\s*20\d{{2}}"
    return F.coalesce(
        F.when(text.rlike(end), F.coalesce(
            rule(month_number(part(text, span, 1)), _int(part(text, span, 3))),
            rule(month_number(part(text, closing, 1)), _int(part(text, closing, 3))),
        )),
        rule(_int(part(text, slashed, 1)), _int(part(text, slashed, 3))),
        rule(_int(part(name, dated, 2)), _int(part(name, dated, 1))),
        rule(month_number(part(name, named, 1)), _int(part(name, named, 2))),
        rule(F.lit(12), _int(part(name, bare, 1))),
        rule(_int(part(text, short, 4)), _int(part(text, short, 6)) + 2000),
        rule(F.lit(None).cast("int"), _int(part(text, anywhere, 1)) + 2000),
        rule(F.lit(None).cast("int"), F.lit(2025)),
    )


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def year_key(date: Column) -> Column:
    return F.date_format(date, "yyyy")


def in_month(date: Column, month: str) -> Column:
    """`date` falls in month 'YYYY-MM': a range test, so it prunes and pushes down."""
    start = F.lit(month[:7] + "-01").cast("date")
    return (date >= start) & (date < F.add_months(start, 1))


def in_year(date: Column, year: str) -> Column:
    start = F.lit(f"{int(str(year)[:4]):04d}-01-01").cast("date")
    return (date >= start) & (date < F.add_months(start, 12))


def last_month(date: Column, as_of: str) -> Column:
    start = F.trunc(F.lit(as_of).cast("date"), "MM")
    return (date >= F.add_months(start, -1)) & (date < start)


def this_month(date: Column, as_of: str) -> Column:
    return date >= F.trunc(F.lit(as_of).cast("date"), "MM")


def this_year(date: Column, as_of: str) -> Column:
    return in_year(date, as_of[:4])


def day_distance(first: Column, last: Column) -> Column:
    return F.datediff(last, first)


def clean_timestamp(raw: Column) -> Column:
    """Timestamp text with stray letters removed; null when still unreadable."""
    text = strip_garbage(raw)
    return F.coalesce(
        *[F.try_to_timestamp(text, F.lit(f)) for f in
          ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss",
           "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd")]
    )


def strip_garbage(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"[^0-9\s:\-.+Z]", ""))


def renormalise_date(raw: Column) -> Column:
    """Four known spellings -> `yyyy-MM-dd`; any other text stays as it is."""
    parsed = F.coalesce(
        *[F.try_to_date(raw, f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyyMMdd")]
    )
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), raw)
