"""Text cleaning and rule functions (all JVM-side column expressions)."""

from pyspark.sql import Column, DataFrame, functions as F

from pennywright.functions import fixed_values as fv
from pennywright.functions.matching import contains_any, first_category, first_rule, once

_BLANKS = " \t\n\r\f\x0b"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; none at either end."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def clean_card(raw: Column) -> Column:
    """Upper-case and drop noise in the fixed order (the order matters)."""
    text = F.upper(raw)
    for pattern in fv.CARD_NOISE:
        text = F.regexp_replace(text, "(?i)" + pattern, " ")
    return strip(text)


def title_case(text: Column) -> Column:
    """Capital after every non-letter, so `AT&T` stays and `O'REILLY` is `O'Reilly`."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def clean_bank(raw: Column) -> Column:
    """Drop noise; title-case only text that is all upper or all lower case."""
    text = raw
    for pattern in fv.BANK_NOISE:
        text = F.regexp_replace(text, pattern, " ")

    def shown(t):
        return F.when(t.rlike(r"\p{Lu}") != t.rlike(r"\p{Ll}"), title_case(t)).otherwise(t)

    return once(strip(text), shown)


def with_line_merchant(df: DataFrame, description: str = "description") -> DataFrame:
    """Add merchant_name and category of statement lines.

    The searched texts are columns of their own, so that the rules, which look at
    them many times, do not compute them again.
    """
    text = F.col(description)
    bare = F.regexp_replace(text, r"#\d+", "")
    bare = F.regexp_replace(bare, r"\s+\d{4,}", "")
    bare = F.regexp_replace(bare, r"(?i)\bDBA\b.*", "")
    bare = strip(F.regexp_replace(bare, r"\s{2,}", " "))
    named = df.withColumns({"_upper": F.upper(text), "_bare": bare})
    other = title_case(F.when(F.col("_bare") != "", F.col("_bare")).otherwise(text))
    named = named.withColumn(
        "merchant_name", first_rule(F.col("_upper"), fv.LINE_MERCHANTS, other)
    )
    both = F.lower(F.concat_ws(" ", "merchant_name", description))
    return (
        named.withColumn("_both", both)
        .withColumn("category", first_category(F.col("_both"), fv.LINE_CATEGORIES,
                                               F.lit("Other")))
        .drop("_upper", "_bare", "_both")
    )


def with_bank_category(df: DataFrame, description: str = "description") -> DataFrame:
    """Add the keyword category of a bank description."""
    searched = df.withColumn("_upper", F.upper(description))
    category = first_category(F.col("_upper"), fv.BANK_CATEGORIES, F.lit("Uncategorized"))
    return searched.withColumn("category", category).drop("_upper")


def bank_confidence(category: Column) -> Column:
    return F.when(category == "Uncategorized", F.lit(0.3)).otherwise(F.lit(1.0))


def method_label(confidence: Column) -> Column:
    return F.when(confidence >= 1.0, "rule_based").otherwise("fallback")


def card_issuer(text: Column) -> Column:
    """Issuer whose signature appears first in the ordered list, else `unknown`."""
    return first_category(F.lower(text), fv.BANK_SIGNATURES, F.lit("unknown"))


def anomaly_flags(amount: Column, category: Column) -> Column:
    flags = F.array(
        F.when(F.abs(amount) > 300, F.lit("large_transaction")),
        F.when(category == "Uncategorized", F.lit("needs_review")),
    )
    return F.filter(flags, lambda flag: flag.isNotNull())


def merchant_hint(raw: Column) -> Column:
    """First three meaningful words: no ids, phone numbers, state codes or single marks."""
    words = F.transform(
        F.split(strip(raw), r"\s+"),
        lambda word: F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""),
    )
    kept = F.filter(
        words,
        lambda word: (F.length(word) > 1)
        & ~word.rlike(r"^\d{4,}$|^\d{3}-\d{3}-\d{4}$|^[A-Z]{2}$"),
    )
    return once(
        F.array_join(F.slice(kept, 1, 3), " "),
        lambda hint: F.when(hint != "", hint).otherwise(F.substring(raw, 1, 20)),
    )


def first_word(cleaned: Column, raw: Column) -> Column:
    """First word longer than two characters, title-cased; else the raw head."""
    words = F.filter(F.split(cleaned, r"\s+"), lambda word: F.length(word) > 2)
    return F.when(F.size(words) > 0, title_case(F.get(words, F.lit(0)))).otherwise(
        strip(F.substring(raw, 1, 20))
    )


def location(raw: Column, places=tuple(fv.PLACE_NAMES)) -> Column:
    """Up to two place names: a known city and a trailing state code."""
    text = F.upper(raw)
    city = F.when(contains_any(text, places), F.initcap(
        F.regexp_extract(text, r"\b(" + "|".join(places) + r")\b", 1)))
    code = F.right(text, F.lit(2))
    state = F.when(code.isin(fv.US_STATES) & ~F.substring(text, -3, 1).rlike(r"\w"), code)
    found = F.array_join(F.filter(F.array(city, state), lambda part: part != ""), ", ")
    return once(found, lambda t: F.when(t != "", t))


def is_header_line(line: Column) -> Column:
    """Header or footer: a header word is present and no date is."""
    return contains_any(F.lower(line), fv.HEADER_WORDS) & ~line.rlike("(?i)" + fv.LINE_DATE)


def like_pattern(value: str) -> str:
    return f"%{value}%"


def holds(column: Column, value: str) -> Column:
    """Case-insensitive LIKE '%value%'; `%` and `_` in the value stay wildcards."""
    return column.ilike(like_pattern(value))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*columns)
