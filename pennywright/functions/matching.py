"""Ordered "first rule wins" matching.

Long word lists are literal arrays searched by higher-order functions, so the
generated code stays small however long a list is.  `once` binds the searched
text to a variable; without it a lambda would compute the text again per word.
"""

import re

from pyspark.sql import Column, functions as F

_META = re.compile(r"[\\.^$*+?{}\[\]|()]")
_FEW = 8


def _words(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def once(value: Column, fn) -> Column:
    """`fn(value)` with `value` computed a single time."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def contains_any(text: Column, words) -> Column:
    """True where `text` contains one of `words`; plain substring search, no regex."""
    words = list(words)
    if len(words) > _FEW:
        return once(text, lambda t: F.exists(_words(words), lambda word: t.contains(word)))
    hit = text.contains(words[0])
    for word in words[1:]:
        hit = hit | text.contains(word)
    return hit


def matches(text: Column, pattern: str) -> Column:
    """`rlike`, or substring search where every alternative of the pattern is literal."""
    parts = pattern.split("|")
    if all(not _META.search(part) for part in parts):
        return contains_any(text, parts)
    return text.rlike(pattern)


def matches_any(text: Column, patterns, ignore_case: bool = False) -> Column:
    """True where one of the regexes is found; a single alternation, one pass."""
    flag = "(?i)" if ignore_case else ""
    return text.rlike(flag + "|".join(f"(?:{p})" for p in patterns))


def first_rule(text: Column, rules: dict, otherwise: Column | None = None) -> Column:
    """Value of the first (pattern -> value) entry found in `text`."""
    case = None
    for pattern, value in rules.items():
        test = matches(text, pattern)
        case = F.when(test, value) if case is None else case.when(test, value)
    return case if otherwise is None else case.otherwise(otherwise)


def first_category(text: Column, categories: dict, otherwise: Column | None = None) -> Column:
    """Name of the first (name -> words) entry with a word contained in `text`.

    The names follow the words in list order, so the first word found decides.
    """
    pairs = [(word, name) for name, words in categories.items() for word in words]

    def name_of(t):
        hits = F.transform(_words(w for w, _ in pairs), lambda word: t.contains(word))
        place = F.array_position(hits, F.lit(True)).cast("int")
        return F.get(_words(n for _, n in pairs), place - 1)

    name = once(text, name_of)
    return name if otherwise is None else F.coalesce(name, otherwise)
