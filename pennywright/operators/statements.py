"""Statement lines -> transactions, for each bank format.

Input is a lines frame (file_id, line_no, line) of stripped, non-blank lines.
A statement is a state machine over its lines: a section starts at a header, a
transaction opens at a dated line and takes the lines below it.  Both are "the
last mark above this line", so both are `carry_forward`.
"""

from pyspark.sql import Column, DataFrame, functions as F

from pennywright.functions import fixed_values as fv
from pennywright.functions.dates import (
    billing_period, iso_date, long_date, month_day_date, month_number, period_date, slash_date,
    year_for_month,
)
from pennywright.functions.matching import contains_any, matches_any
from pennywright.functions.money import MONEY, loan_interest, signed_type
from pennywright.functions.text import card_issuer, strip, with_line_merchant
from pennywright.operators.extract import line_transactions
from pennywright.operators.windows import carry_forward
from pennywright.sources.scratch import written
from pennywright.sources.statement_text import is_noise

FILE = ["file_id"]
_DATED = rf"^({fv.DCU_MONTHS})\d{{2}}\s+"
_MONTH_MARK = rf"\b({fv.DCU_MONTHS})\d{{2}}\b"
BANK_ROW = ["file_id", "line_no", "bank_name", "account_type", "date", "description", "amount",
            "transaction_type", "balance", "raw_text"]
LOAN_ROW = ["file_id", "line_no", "bank_name", "loan_identifier", "date", "description",
            "payment_amount", "principal_amount", "interest_amount", "balance", "raw_text"]
CARD_ROW = ["file_id", "line_no", "bank_name", "date", "description", "amount",
            "transaction_type", "merchant_name", "category", "balance", "raw_text",
            "confidence_score"]


def _money(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast(MONEY)


def _amounts(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(fv.STATEMENT_AMOUNT), 0)


def _from_end(items: Column, n: int) -> Column:
    return F.try_element_at(items, F.lit(-n))


def last_place(text: Column, part: Column) -> Column:
    """0-based place of the last `part` in `text`, which contains it."""
    tail = F.call_function("substring_index", text, part, F.lit(-1))
    return F.length(text) - F.length(tail) - F.length(part)


def first_match(lines: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Per file, the groups of the first line where `pattern` is found.

    Aggregates before the shuffle; one row per file remains.
    """
    hit = lines.filter(F.col("line").rlike(pattern))
    groups = F.struct(*[F.regexp_extract("line", pattern, i + 1).alias(n)
                        for i, n in enumerate(names)])
    return hit.groupBy(*FILE).agg(F.min_by(groups, "line_no").alias("_p")).select(
        *FILE, *[F.col(f"_p.{n}").alias(n) for n in names]
    )


def periods(lines: DataFrame, fmt: str) -> DataFrame:
    """Statement period of each file as dates (files without one have no row)."""
    pattern, parse = {
        "dcu": (fv.DCU_PERIOD, period_date),
        "boa": (fv.BOA_PERIOD, long_date),
        "chase": (fv.CHASE_PERIOD, long_date),
    }[fmt]
    found = first_match(lines, pattern, ["start", "end"])
    return found.select(
        *FILE, parse(F.col("start")).alias("period_start"), parse(F.col("end")).alias("period_end")
    )


def _with_period(rows: DataFrame, lines: DataFrame, fmt: str) -> DataFrame:
    return rows.join(periods(lines, fmt), FILE, "left")


# --------------------------------------------------------------- sections
def dcu_sections(lines: DataFrame) -> DataFrame:
    """Lines with their section; legal text ends a section, headers are left out.

    The loan header stays, as it carries the previous balance.
    """
    line = F.col("line")
    mark = (
        F.when(line.rlike(fv.DCU_BOILERPLATE), "none")
        .when(line.rlike(fv.DCU_SUMMARY), "summary")
        .when(line.rlike(fv.DCU_SAVINGS), "savings")
        .when(line.rlike(fv.DCU_CHECKING), "checking")
        .when(line.rlike(fv.DCU_LOAN), "loan")
    )
    marked = carry_forward(lines.withColumn("_mark", mark), FILE, "line_no",
                           {"section": F.col("_mark")})
    inside = (F.col("section") != "none") & (
        F.col("_mark").isNull() | (F.col("_mark") == "loan")
    )
    return marked.filter(inside).drop("_mark")


def mark_section(lines: DataFrame, holder_names=()) -> DataFrame:
    """Add `inside`: the line belongs to the transactions section and is not noise."""
    line = F.col("line")
    end = matches_any(line, fv.SECTION_END, ignore_case=True)
    mark = F.when(end, "end").when(matches_any(line, fv.SECTION_START, ignore_case=True), "start")
    state = carry_forward(lines.withColumn("_mark", mark), FILE, "line_no",
                          {"_state": F.col("_mark")}, before=True)
    undated = ~line.rlike(r"^\d{2}/\d{2}") & ~line.rlike(r"^[A-Z][a-z]{2}\s+\d")
    bleed = undated & (line.rlike(r"^\d{1,4}$") | line.rlike("(?i)" + fv.REWARD_BLEED))
    keep = F.col("_state").eqNullSafe("start") & ~F.col("_mark").eqNullSafe("end")
    inside = keep & ~is_noise(line, holder_names) & ~bleed
    return state.withColumn("inside", inside).drop("_mark", "_state")


def card_section(lines: DataFrame, holder_names=()) -> DataFrame:
    """Lines inside the transactions section of a card statement, without noise."""
    return mark_section(lines, holder_names).filter("inside").drop("inside")


# --------------------------------------------------------------- continuation
def open_rows(lines: DataFrame, kind: Column, keys, separator: str) -> DataFrame:
    """Opening lines with the text of the lines that continue them.

    `kind` is open, stop (closes without opening), cont or drop (ignored).
    Adds `continued`: the continuation lines joined in order, or null.
    """
    keys = list(keys)
    kinds = lines.withColumn("_kind", kind).filter("_kind <> 'drop'")
    # the last mark above decides: an open line, or -1 for a stop
    owner = F.when(F.col("_kind") == "open", F.col("line_no")).when(
        F.col("_kind") == "stop", F.lit(-1).cast("long")
    )
    owned = carry_forward(kinds, keys, "line_no", {"_owner": owner}).filter("_owner >= 0")
    own = [c for c in lines.columns if c not in keys]
    tail = F.struct(F.col("line_no").alias("n"), "line")
    rows = owned.groupBy(*keys, "_owner").agg(
        F.max(F.when(F.col("_kind") == "open", F.struct(*own))).alias("_row"),
        F.array_sort(F.collect_list(F.when(F.col("_kind") == "cont", tail))).alias("_tail"),
    )
    joined = F.array_join(F.transform("_tail", lambda t: t["line"]), separator)
    return rows.select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in own],
        F.when(F.size("_tail") > 0, joined).alias("continued"),
    )


def _joined(description: Column) -> Column:
    return F.concat_ws(" | ", description, "continued")


# --------------------------------------------------------------- credit union
def _dcu_description(line: Column, n: int) -> Column:
    """Text between the date and the first of the last `n` amounts.

    `_n` holds the amounts of the line.  Each is looked up by its last occurrence,
    so an amount that is also the tail of a later one is found inside it.
    """
    start = F.length(F.regexp_extract(line, r"^\S+", 0))
    cuts = []
    for i in range(1, n + 1):
        place = last_place(line, _from_end(F.col("_n"), i))
        cuts.append(F.when(place > start, place))
    cut = F.least(*cuts, F.length(line))
    return strip(F.substring(line, start + 1, cut - start))


def dcu_savings(lines: DataFrame, sections: DataFrame = None) -> DataFrame:
    """One-line savings transactions: the last two amounts are amount and balance."""
    line = F.col("line")
    rows = _section(lines, sections, "savings").filter(
        line.rlike(_DATED) & ~contains_any(line, fv.DCU_STOP_SAVINGS)
    ).withColumn("_n", _amounts(line)).filter(F.size("_n") >= 2)
    return _dcu_bank_rows(rows.withColumn("continued", F.lit(None).cast("string")), lines,
                          "savings")


def dcu_checking(lines: DataFrame, sections: DataFrame = None) -> DataFrame:
    """Checking transactions with continuation lines.

    A stop line, or a dated line with fewer than two amounts, closes the open
    transaction; a line with two or more dates is ignored and closes nothing.
    """
    line = F.col("line")
    dated = line.rlike(_DATED)
    kind = (
        F.when(contains_any(line, fv.DCU_STOP_CHECKING), "stop")
        .when(dated & (F.regexp_count(line, F.lit(_MONTH_MARK)) > 1), "drop")
        .when(dated & (F.size(_amounts(line)) >= 2), "open")
        .when(dated, "stop")
        .otherwise("cont")
    )
    rows = open_rows(_section(lines, sections, "checking"), kind, FILE, " ")
    return _dcu_bank_rows(rows.withColumn("_n", _amounts(line)), lines, "checking")


def _section(lines: DataFrame, sections: DataFrame | None, name: str) -> DataFrame:
    if sections is None:
        sections = dcu_sections(lines)
    return sections.filter(F.col("section") == name).drop("section")


def _dcu_bank_rows(rows: DataFrame, lines: DataFrame, account: str) -> DataFrame:
    line = F.col("line")
    parts = rows.select(
        "file_id", "line_no", line.alias("raw_text"),
        F.regexp_extract(line, r"^\S+", 0).alias("_date"),
        _joined(_dcu_description(line, 2)).alias("description"),
        _money(_from_end(F.col("_n"), 2)).alias("_signed"),
        _money(_from_end(F.col("_n"), 1)).alias("balance"),
    )
    return _with_period(parts, lines, "dcu").select(
        "file_id", "line_no", F.lit("dcu").alias("bank_name"), F.lit(account)
        .alias("account_type"),
        month_day_date(F.col("_date"), F.col("period_start"), F.col("period_end")).alias("date"),
        "description", F.abs("_signed").cast(MONEY).alias("amount"),
        signed_type(F.col("_signed"), F.col("description")).alias("transaction_type"),
        "balance", "raw_text",
    )


def dcu_loan(lines: DataFrame, sections: DataFrame = None) -> DataFrame:
    """Loan payments: the last three amounts are payment, principal and balance."""
    line = F.col("line")
    rows = _section(lines, sections, "loan").filter(
        line.rlike(_DATED) & ~contains_any(line, fv.DCU_STOP_LOAN)
    ).withColumn("_n", _amounts(line)).filter(F.size("_n") >= 3)
    header = lines.filter(line.rlike(fv.DCU_LOAN)).groupBy(*FILE).agg(
        F.min_by(strip(F.substring_index(line, "PREVIOUS", 1)), "line_no")
        .alias("loan_identifier")
    )
    parts = rows.select(
        "file_id", "line_no", line.alias("raw_text"),
        F.regexp_extract(line, r"^\S+", 0).alias("_date"),
        _dcu_description(line, 3).alias("description"),
        _money(_from_end(F.col("_n"), 3)).alias("payment_amount"),
        F.abs(_money(_from_end(F.col("_n"), 2))).cast(MONEY).alias("principal_amount"),
        _money(_from_end(F.col("_n"), 1)).alias("balance"),
    ).join(header, FILE, "left")
    return _with_period(parts, lines, "dcu").select(
        "file_id", "line_no", F.lit("dcu").alias("bank_name"),
        F.coalesce("loan_identifier", F.lit("")).alias("loan_identifier"),
        month_day_date(F.col("_date"), F.col("period_start"), F.col("period_end")).alias("date"),
        "description", "payment_amount", "principal_amount",
        loan_interest(F.col("payment_amount"), F.col("principal_amount"))
        .alias("interest_amount"),
        "balance", "raw_text",
    )


# --------------------------------------------------------------- boa
def boa(lines: DataFrame) -> DataFrame:
    """Deposits, subtractions and checks of a national-bank statement."""
    line = F.col("line")
    rows = lines.filter(~line.rlike(fv.BOA_PAGE_HEADER))
    stop = line.rlike("^(?:" + "|".join(fv.BOA_STOP) + ")")
    deposits = line.rlike(fv.BOA_DEPOSITS) & ~F.lower(line).contains("continued")
    mark = F.when(
        ~stop,
        F.when(deposits, "deposits")
        .when(line.rlike(fv.BOA_SUBTRACTIONS), "subtractions")
        .when(line.rlike(fv.BOA_CHECKS), "checks"),
    )
    marked = carry_forward(rows.withColumn("_mark", mark), FILE, "line_no",
                           {"_section": F.col("_mark")})
    dated = line.rlike(r"^\d{2}/\d{2}/\d{2} ")
    kind = (
        F.when(stop | F.col("_mark").isNotNull(), "stop")
        .when(dated & (F.size(_amounts(line)) > 0) & F.col("_section").isNotNull(), "open")
        .when(dated, "stop")
        .when(F.col("_section").eqNullSafe("checks"), "drop")
        .otherwise("cont")
    )
    opened = open_rows(marked, kind, FILE, " ").withColumn("_n", _amounts(line))
    two = F.size("_n") >= 2
    amount = F.when(two, _from_end(F.col("_n"), 2)).otherwise(_from_end(F.col("_n"), 1))
    words = F.split(line, r"\s+")
    number = F.when(F.size(words) >= 3, F.get(words, F.lit(1)))
    text = strip(F.substring(line, F.lit(10), last_place(line, amount) - 9))
    description = F.when(
        F.col("_section") == "checks",
        F.when(number.isNotNull(), F.concat(F.lit("Check #"), number)).otherwise("Check"),
    ).otherwise(text)
    return opened.select(
        "file_id", "line_no", F.lit("boa").alias("bank_name"),
        F.lit("checking").alias("account_type"),
        period_date(F.substring(line, 1, 8)).alias("date"),
        _joined(description).alias("description"),
        F.abs(_money(amount)).cast(MONEY).alias("amount"),
        F.when(F.col("_section") == "deposits", "CREDIT").otherwise("DEBIT")
        .alias("transaction_type"),
        F.when(two, F.abs(_money(_from_end(F.col("_n"), 1)))).cast(MONEY).alias("balance"),
        line.alias("raw_text"),
    )


# --------------------------------------------------------------- chase
def chase(lines: DataFrame) -> DataFrame:
    """Transactions between the start and end markers; the sign is the type."""
    line = F.col("line")
    lower = F.lower(line)
    mark = F.when(lower == fv.CHASE_START, "in").when(lower == fv.CHASE_END, "out")
    marked = carry_forward(lines.withColumn("_mark", mark), FILE, "line_no",
                           {"_section": F.col("_mark")})
    dated = line.rlike(fv.CHASE_DATE)
    kind = (
        F.when(F.col("_mark") == "out", "stop")
        .when(F.col("_mark").isNotNull() | ~F.col("_section").eqNullSafe("in"), "drop")
        .when(line.rlike(fv.CHASE_SKIP), "stop")
        .when(line.rlike(fv.CHASE_PERIOD) | line.rlike(fv.CHASE_ACCOUNT), "drop")
        .when(dated & (F.size(_amounts(line)) >= 2), "open")
        .when(dated, "stop")
        .otherwise("cont")
    )
    opened = open_rows(marked, kind, FILE, " | ").withColumn("_n", _amounts(line))
    signed, balance = (_from_end(F.col("_n"), i) for i in (2, 1))
    head = F.substring(line, F.lit(1), last_place(line, balance))
    start = F.length(F.regexp_extract(line, fv.CHASE_DATE, 0))
    text = strip(F.substring(line, start + 1, last_place(head, signed) - start))
    description = strip(F.regexp_replace(text, fv.CHASE_LABEL, ""))
    parts = opened.select(
        "file_id", "line_no", line.alias("raw_text"),
        F.regexp_extract(line, fv.CHASE_DATE, 1).alias("_date"),
        _joined(description).alias("description"),
        _money(signed).alias("_signed"),
        F.abs(_money(balance)).cast(MONEY).alias("balance"),
    )
    return _with_period(parts, lines, "chase").select(
        "file_id", "line_no", F.lit("chase").alias("bank_name"),
        F.lit("checking").alias("account_type"),
        slash_date(F.col("_date"), F.col("period_start"), F.col("period_end")).alias("date"),
        "description", F.abs("_signed").cast(MONEY).alias("amount"),
        F.when(F.col("_signed") < 0, "DEBIT").otherwise("CREDIT").alias("transaction_type"),
        "balance", "raw_text",
    )


# --------------------------------------------------------------- cards
_CARD_LINES = {
    # issuer: (line pattern, date / description / amount groups, credit pattern, confidence)
    "robinhood": (
        r"(?i)^(\d{2}/\d{2})\s+\d{2}/\d{2}\s+[A-Z0-9]{10,}\s+(.+?)\s+([\d,]+\.\d{2}-?)$",
        r"-$", 0.95),
    "citi": (
        r"(?i)^(\d{2}/\d{2})\s+(?:\d{2}/\d{2}\s+)?([^$]+?)\s+(-?\$[\d,]+\.\d{2})",
        r"^-", 0.97),
    "bofa": (
        r"^(\d{2}/\d{2})\s+\d{2}/\d{2}\s+(.+?)\s+\d{4}\s+\d{4}\s+(-?[\d,]+\.\d{2})$",
        r"^-", 0.96),
    "capital_one": (
        r"^([A-Z][a-z]{2}\s+\d{1,2})\s+[A-Z][a-z]{2}\s+\d{1,2}\s+(.+?)\s+"
        r"((?:-\s*)?\$[\d,]+\.\d{2})$",
        r"^-", 0.96),
}
_CITI_HEADER = r"(?i)^(Trans\.?|Post|date|Description)\b"


def card_issuers(files: DataFrame) -> DataFrame:
    """Files with issuer, closing_month and closing_year."""
    period = billing_period(F.col("content"), F.col("filename"))
    return files.withColumns(
        {"issuer": card_issuer(F.col("content")), "_p": period}
    ).select(
        *[c for c in files.columns if c != "content"], "issuer",
        F.col("_p.closing_month").alias("closing_month"),
        F.col("_p.closing_year").alias("closing_year"),
    )


def _by_issuer(fn) -> Column:
    """CASE over the issuer column: fn(pattern, credit pattern, confidence, issuer)."""
    case = None
    for issuer, rule in _CARD_LINES.items():
        test, value = F.col("issuer") == issuer, fn(*rule, issuer)
        case = F.when(test, value) if case is None else case.when(test, value)
    return case


def card_lines(section: DataFrame) -> DataFrame:
    """Transactions of section lines of the known issuers, all in one pass.

    `section` has file_id, line_no, line, issuer, closing_month and closing_year.
    """
    line = F.col("line")
    found = section.filter(_by_issuer(lambda p, *_: line.rlike(p))).select(
        "file_id", "line_no", "issuer", "closing_month", "closing_year", line.alias("raw_text"),
        _by_issuer(lambda p, *_: F.regexp_extract(line, p, 1)).alias("_date"),
        strip(_by_issuer(lambda p, *_: F.regexp_extract(line, p, 2))).alias("description"),
        _by_issuer(lambda p, *_: F.regexp_extract(line, p, 3)).alias("_amount"),
    )
    header = (F.col("description") == "") | F.col("description").rlike(_CITI_HEADER)
    found = found.filter((F.col("issuer") != "citi") | ~header)
    day = F.col("_date")
    named = F.col("issuer") == "capital_one"
    month = F.when(named, month_number(day)).otherwise(F.substring(day, 1, 2).try_cast("int"))
    day_no = F.when(named, F.regexp_extract(day, r"(\d{1,2})$", 1)).otherwise(
        F.substring(day, 4, 2)).try_cast("int")
    dated = found.withColumns({"_month": month, "_day": day_no})
    year = year_for_month(F.col("_month"), F.col("closing_month"), F.col("closing_year"))
    rows = dated.select(
        "file_id", "line_no", F.col("issuer").alias("bank_name"),
        iso_date(year, F.col("_month"), F.col("_day")).alias("date"), "description",
        _money(F.regexp_replace("_amount", r"[-$\s]", "")).alias("amount"),
        F.when(_by_issuer(lambda p, credit, *_: F.col("_amount").rlike(credit)), "CREDIT")
        .otherwise("DEBIT").alias("transaction_type"),
        F.lit(None).cast(MONEY).alias("balance"), "raw_text",
        _by_issuer(lambda p, c, confidence, i: F.lit(confidence)).alias("confidence_score"),
    )
    return with_line_merchant(rows).select(*CARD_ROW)


def card_statements(files: DataFrame, lines: DataFrame, holder_names=()) -> DataFrame:
    """Transactions of card statements of any issuer.

    The four known issuers read only their transactions section (none without
    one).  Other files read the section if it has lines, else the whole text.
    The lines that can count are marked and written once, for all three readers of them.
    """
    info = card_issuers(files).select("file_id", "issuer", "closing_month", "closing_year")
    known = F.col("issuer").isin(*fv.CARD_FORMATS)
    chosen = written(mark_section(lines, holder_names).join(info, "file_id").filter(
        F.col("inside") | ~known), "card-lines")
    filled = chosen.filter(~known & F.col("inside")).select("file_id").distinct().withColumn(
        "_filled", F.lit(True))
    generic_lines = chosen.filter(~known).join(filled, "file_id", "left").filter(
        F.col("inside") | F.col("_filled").isNull())
    generic = line_transactions(generic_lines).select(
        "file_id", "line_no", F.col("issuer").alias("bank_name"),
        F.col("parsed_date").alias("date"), "description", "amount", "transaction_type",
        "merchant_name", "category", F.lit(None).cast(MONEY).alias("balance"), "raw_text",
        "confidence_score",
    )
    return generic.select(*CARD_ROW).unionByName(card_lines(chosen.filter(known)))


# --------------------------------------------------------------- all bank files
def bank_rows(lines_by_format: dict[str, DataFrame], sections: DataFrame = None) -> DataFrame:
    """Bank transactions of all formats; savings and checking of a file together."""
    parts = []
    if "dcu" in lines_by_format:
        lines = lines_by_format["dcu"]
        sections = dcu_sections(lines) if sections is None else sections
        parts += [dcu_savings(lines, sections), dcu_checking(lines, sections)]
    if "boa" in lines_by_format:
        parts.append(boa(lines_by_format["boa"]))
    if "chase" in lines_by_format:
        parts.append(chase(lines_by_format["chase"]))
    rows = parts[0].select(*BANK_ROW)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*BANK_ROW))
    return rows


def statement_metadata(files: DataFrame, lines: DataFrame, rows: DataFrame, fmt: str,
                       loans: DataFrame = None) -> DataFrame:
    """One row per file: period, number of transactions, debit and credit totals."""
    debit = F.when(F.col("transaction_type") == "DEBIT", F.col("amount"))
    credit = F.when(F.col("transaction_type") == "CREDIT", F.col("amount"))
    totals = rows.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(debit).alias("_d"), F.sum(credit).alias("_c")
    )
    result = files.join(periods(lines, fmt), FILE, "left").join(totals, FILE, "left")
    count = F.coalesce("_n", F.lit(0))
    if loans is not None:
        paid = loans.groupBy(*FILE).agg(F.count(F.lit(1)).alias("_loans"))
        result = result.join(paid, FILE, "left")
        count = count + F.coalesce("_loans", F.lit(0))
    return result.select(
        *[c for c in files.columns if c != "content"],
        F.lit(fmt).alias("bank_name"),
        F.col("period_start").alias("statement_period_start"),
        F.col("period_end").alias("statement_period_end"),
        count.alias("total_transactions"),
        F.coalesce("_d", F.lit(0)).cast(MONEY).alias("total_debits"),
        F.coalesce("_c", F.lit(0)).cast(MONEY).alias("total_credits"),
    )
