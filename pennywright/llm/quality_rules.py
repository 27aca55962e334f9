"""Quality rules as a short-circuit cascade, DataFrame functions only.

A rule rejects a document on statistics of its text.  Every rule says which
statistics it reads and how much work they cost.  On a bounded sample each
rule's mean work and rejected share are estimated, and rules run in the order
of rejection per work; a document that one rule rejects is not measured for
the rules behind it.  The order only decides the work done, never the verdict.

Defined results: a null text counts as empty; repeated rows are judged one by
one; rows with a null doc_id are judged like others; an empty table gives an
empty result; columns of the input that the operator does not read are kept by
`keep_documents` and left out by `measure`, whatever their names.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pennywright.llm.shared import SPACE_CHARS, words_of

SYMBOLS = "[#*$%&|<>]"
SAMPLE_ROWS = 2000  # rows on which work and rejection are estimated
PREFIX = "__qr_"  # of working columns


def _c(name: str) -> Column:
    return F.col(PREFIX + name)


#: Statistic -> expressions by working column, in steps.  A later step reads earlier ones;
#: keeping them apart stops the optimizer from writing one expression out several times.
STEPS: dict[str, list[dict[str, Column]]] = {}


def _fill_steps() -> None:
    text, words, lines = _c("text"), _c("words"), _c("lines")
    STEPS["n_symbols"] = [{
        "n_symbols": F.size(F.split(text, SYMBOLS)) - 1,
    }]
    STEPS["word_chars"] = [{
        "word_chars": F.length(F.array_join(words, "")),
    }]
    STEPS["words"] = [{"words": words_of(text)}]
    STEPS["n_words"] = [{"n_words": F.size(words)}]
    STEPS["lines"] = [{
        "lines": F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(SPACE_CHARS)) != ""),
    }]
    STEPS["n_lines"] = [{"n_lines": F.size(lines)}]
    STEPS["n_dup_lines"] = [{"n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines))}]
    hashes, triples, ranked = _c("hashes"), _c("triples"), _c("ranked")
    triple = F.slice(
        F.transform(
            hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2))),
        1, F.greatest(F.size(hashes) - 2, F.lit(0)),
    )
    again = F.filter(ranked, lambda e, i: (
        F.coalesce(e["h"] == F.get(ranked, i - 1)["h"], F.lit(False))
        | F.coalesce(e["h"] == F.get(ranked, i + 1)["h"], F.lit(False))
    ))
    starts = F.sort_array(F.transform(again, lambda e: e["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")
        ),
        lambda acc: acc["n"],
    )
    STEPS["n_repeat_words"] = [
        {"hashes": F.transform(words, lambda w: F.xxhash64(w))},
        {"triples": triple},
        {"ranked": F.when(
            F.size(F.array_distinct(triples)) < F.size(triples),
            F.sort_array(F.transform(
                triples, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        )},
        {"n_repeat_words": F.when(ranked.isNull(), F.lit(0)).otherwise(covered)},
    ]


#: Statistics that another one is made from, in order.
NEEDS = {
    "n_words": ["words"], "n_repeat_words": ["words"], "word_chars": ["words"],
    "n_lines": ["lines"], "n_dup_lines": ["lines"],
}


@dataclass(frozen=True)
class Rule:
    """`reject` is a SQL condition over the statistics named in `reads`; `work` estimates
    the operations per document, over n_chars and n_words."""

    name: str
    reads: tuple[str, ...]
    reject: str
    work: str


#: Rules of the base verdict and of the method.  Bounds are whole numbers.
FEW_WORDS = Rule("few_words", ("n_words",), "n_words < 50", "2 * n_chars")
REPEATS = Rule("repeated_words", ("n_words", "n_repeat_words"),
               "100 * n_repeat_words > 50 * n_words",
               "2 * n_chars + n_words * (20 + 4 * log2(n_words + 1))")
SYMBOL_SHARE = Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > n_words",
                    "3 * n_chars")
WORD_LENGTH = Rule("word_length", ("n_words", "word_chars"),
                   "word_chars < 3 * n_words OR word_chars > 10 * n_words", "3 * n_chars")
DUP_LINES = Rule("duplicate_lines", ("n_lines", "n_dup_lines"),
                 "100 * n_dup_lines > 50 * n_lines", "2 * n_chars")
BASE = (FEW_WORDS, REPEATS)
METHOD = (SYMBOL_SHARE, WORD_LENGTH, DUP_LINES)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _needed(stats) -> list[str]:
    out = []
    for stat in stats:
        for s in [*NEEDS.get(stat, []), stat]:
            if s not in out:
                out.append(s)
    return out


def _with(df: DataFrame, stats, open_rows: Column | None = None) -> DataFrame:
    """Add working columns for `stats`; only for rows where `open_rows` holds, if given."""
    if not STEPS:
        _fill_steps()
    for stat in _needed(stats):
        if f"{PREFIX}{stat}" in df.columns:
            continue
        for step in STEPS[stat]:
            df = df.withColumns({
                PREFIX + k: v if open_rows is None else F.when(open_rows, v)
                for k, v in step.items()
            })
    return df


def _condition(sql: str) -> Column:
    """A rule's condition over working columns; unknown counts as not rejected."""
    names = sorted({*STEPS, "n_chars"} - {"words", "lines"}, key=len, reverse=True)
    for n in names:
        sql = re.sub(rf"(?<![\w`]){n}\b", f"`{PREFIX}{n}`", sql)
    return F.expr(sql)


def ordered_rules(docs: DataFrame, rules, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by estimated rejection per work, best first; ties keep the given order."""
    rules = list(rules)
    sample = _text_only(docs).limit(sample_rows)
    stats = ["n_words", *(s for r in rules for s in r.reads)]
    measured = _with(sample, stats).withColumn(PREFIX + "n_chars", F.length(_c("text")))
    found = measured.agg(*[
        x for i, r in enumerate(rules) for x in (
            F.avg(F.when(_condition(r.reject), 1.0).otherwise(0.0)).alias(f"s{i}"),
            F.avg(_condition(f"double(1 + {r.work})")).alias(f"w{i}"),
        )
    ]).first()
    gain = [(found[f"s{i}"] or 0.0) / (found[f"w{i}"] or 1.0) for i in range(len(rules))]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-gain[i], i))]


def _text_only(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text"), F.lit("")).alias(PREFIX + "text"))


def _cascade(df: DataFrame, rules) -> DataFrame:
    """Add the name of the first rule in order that rejects, null if none does.

    Each rule's statistics are made only for the rows still open before it.
    """
    failed = PREFIX + "failed"
    if failed not in df.columns:
        df = df.withColumn(failed, F.lit(None).cast("string"))
    for rule in rules:
        df = _with(df, rule.reads, F.col(failed).isNull())
        hit = F.coalesce(_condition(rule.reject), F.lit(False))
        df = df.withColumn(failed, F.when(F.col(failed).isNotNull(), F.col(failed))
                           .when(hit, F.lit(rule.name)))
    return df


def keep_documents(docs: DataFrame, rules=BASE + METHOD, order=None) -> DataFrame:
    """Rows of `docs` that no rule rejects, all columns as given."""
    rules = order or ordered_rules(docs, rules)
    df = docs.withColumn(PREFIX + "text", F.coalesce(F.col("text"), F.lit("")))
    # a filter would be pushed below the statistics and written out once per use of each;
    # exploding no entry drops a row just as well and stays where it is
    one = F.when(_c("failed").isNull(), F.array(F.lit(True)))
    return _cascade(df, rules).select(*docs.columns, F.explode(one).alias(PREFIX + "one")).select(
        *docs.columns)


def measure(docs: DataFrame, base=BASE, method=METHOD) -> DataFrame:
    """doc_id, the five counts, base_failed and kept, one row per row of `docs`.

    Counts are returned for every document.  The method's own rules run as a
    cascade over rows that the base rules leave open.
    """
    order = ordered_rules(docs, method)
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias(PREFIX + "text"))
    df = _with(df, COUNTS)
    base_failed = F.lit(False)
    for rule in base:
        base_failed = base_failed | _condition(rule.reject)
    df = df.withColumn(PREFIX + "base", base_failed)
    df = df.withColumn(PREFIX + "failed", F.when(_c("base"), F.lit("base")))
    df = _cascade(df, order)
    return df.select(
        "doc_id", *[_c(s).cast("long").alias(s) for s in COUNTS],
        _c("base").alias("base_failed"), _c("failed").isNull().alias("kept"),
    )
