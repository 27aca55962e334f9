"""Live feed, portfolio, and conversation queries over events, part, conversations."""

from pyspark.sql import functions as F

from checks.catalog import add
from checks.views import card_feed, holdings, ledger, table, turns
from pennywright.functions import conversation as conv, fixed_values as fv
from pennywright.functions.money import dollars, feed_type, position_values
from pennywright.operators import windows
from pennywright.plans import live, portfolio, usage

JAN = ("2024-01-01", "2024-01-31")
IN_JAN = "date >= DATE '2024-01-01' AND date <= DATE '2024-01-31'"

# ------------------------------------------------------------ live feed
add("a13_live_by_category",
    lambda s, d: live.by_category(card_feed(s, d, "2024-01-01", "2024-02-01"), *JAN,
                                  include_pending=False), f"""
SELECT category, CAST(SUM(amount) AS DOUBLE) AS total_spent, COUNT(*) AS transaction_count
FROM card_feed WHERE {IN_JAN} AND NOT pending AND amount >= 0 GROUP BY category""", "card_feed")

add("a14_live_by_merchant", lambda s, d: live.by_merchant(card_feed(s, d), *JAN, limit=20), f"""
SELECT merchant_name, CAST(SUM(amount) AS DOUBLE) AS total_spent, COUNT(*) AS transaction_count
FROM card_feed WHERE {IN_JAN} AND amount >= 0 GROUP BY merchant_name
ORDER BY total_spent DESC, merchant_name LIMIT 20""", "card_feed")

add("a15_live_summary",
    lambda s, d: live.summary(card_feed(s, d), *live.month_to_date("2024-01-31")), f"""
SELECT '2024-01-01' AS period_start, '2024-01-31' AS period_end,
  CAST(SUM(CASE WHEN amount >= 0 THEN amount END) AS DOUBLE) AS total_spent,
  CAST(ABS(SUM(CASE WHEN amount < 0 THEN amount END)) AS DOUBLE) AS total_credits,
  CAST(SUM(amount) AS DOUBLE) AS net_spend, COUNT(*) AS transaction_count,
  COUNT(CASE WHEN pending THEN 1 END) AS pending_count,
  (SELECT category FROM card_feed WHERE {IN_JAN} AND amount >= 0 GROUP BY category
   ORDER BY SUM(amount) DESC, category DESC LIMIT 1) AS top_category,
  (SELECT merchant_name FROM card_feed WHERE {IN_JAN} AND amount >= 0 GROUP BY merchant_name
   ORDER BY SUM(amount) DESC, merchant_name DESC LIMIT 1) AS top_merchant
FROM card_feed WHERE {IN_JAN}""", "card_feed")

add("p11_live_rows", lambda s, d: live.rows(card_feed(s, d), *JAN, limit=900,
                                            include_pending=False), f"""
SELECT transaction_id, date, merchant_name, CAST(amount AS DOUBLE) AS amount, category,
  CASE WHEN amount < 0 THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type, pending
FROM card_feed WHERE {IN_JAN} AND NOT pending
ORDER BY date DESC, transaction_id LIMIT 500""", "card_feed")

add("f35_feed_rules",
    lambda s, d: card_feed(s, d).select(
        "transaction_id", feed_type(F.col("amount")).alias("transaction_type"),
        F.coalesce("merchant_raw", "name").alias("merchant_name")), """
SELECT transaction_id, CASE WHEN amount < 0 THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type,
  COALESCE(merchant_raw, name) AS merchant_name FROM card_feed""", "card_feed")

# ------------------------------------------------------------ portfolio
EQUITY = "CAST(quantity * current_price AS DECIMAL(18,2))"
# cents of a percent, half away from zero, in whole numbers
PCT_NUM = "CAST((current_price - avg_cost) * 100 AS HUGEINT)"
PCT_DEN = "CAST(avg_cost * 100 AS HUGEINT)"


def half_up(num: str, den: str) -> str:
    """Nearest whole of num/den, halves away from zero, den above zero."""
    return (f"(CASE WHEN {num} < 0 THEN -1 ELSE 1 END) * "
            f"((2 * ABS({num}) + {den}) // (2 * {den}))")


PCT = (f"CASE WHEN avg_cost = 0 THEN 0 ELSE CAST({half_up(f'({PCT_NUM} * 10000)', PCT_DEN)} "
       "AS DOUBLE) / 100.0 END")
POSITIONS_SQL = f"""positions AS (SELECT ticker, name, quantity, avg_cost, current_price,
  {EQUITY} AS equity, {PCT} AS pct_change FROM holdings)"""


def positions(spark, sf_dir):
    held = holdings(spark, sf_dir)
    return held.withColumns(
        position_values(F.col("quantity"), F.col("avg_cost"), F.col("current_price")))


MONEY_COLUMNS = ("quantity", "avg_cost", "current_price", "equity", "pct_change")
AS_DOUBLES = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MONEY_COLUMNS)


def as_doubles(df):
    return df.withColumns({c: dollars(F.col(c)) for c in MONEY_COLUMNS if c in df.columns})


add("f32_position_values", lambda s, d: as_doubles(positions(s, d)), f"""
WITH {POSITIONS_SQL} SELECT ticker, name, {AS_DOUBLES} FROM positions""", "holdings")

add("l03_sorted_holdings",
    lambda s, d: as_doubles(portfolio.holdings(positions(s, d), "pct_change")), f"""
WITH {POSITIONS_SQL} SELECT ticker, name, {AS_DOUBLES} FROM positions""", "holdings")

ONE_TICKER = "SELECT MIN(ticker) FROM holdings"


def some_ticker(spark, sf_dir):
    """A ticker that is held, written in another case and with blanks around it."""
    ticker = holdings(spark, sf_dir).agg(F.min("ticker")).first()[0]
    return f"  {ticker.lower()} "


add("p12_holding_by_ticker",
    lambda s, d: as_doubles(portfolio.by_ticker(positions(s, d), some_ticker(s, d))), f"""
WITH {POSITIONS_SQL} SELECT ticker, name, {AS_DOUBLES} FROM positions
WHERE upper(ticker) = upper(({ONE_TICKER}))""", "holdings")

add("p12_ticker_not_held", lambda s, d: portfolio.not_held(positions(s, d), "zzz"), """
SELECT 'Ticker ''ZZZ'' not found in portfolio.' AS error, ticker AS held_ticker
FROM holdings""", "holdings")

COST = "CAST(SUM(quantity * avg_cost) * 100 AS HUGEINT)"
PL = "(CAST(SUM(equity) * 100 AS HUGEINT) - CAST(SUM(quantity * avg_cost) * 100 AS HUGEINT))"
add("a16_portfolio_summary", lambda s, d: portfolio.summary(positions(s, d)), f"""
WITH {POSITIONS_SQL}, sums AS (SELECT COUNT(*) AS n, CAST(SUM(equity) * 100 AS HUGEINT) AS e,
  CAST(SUM(quantity * avg_cost) * 100 AS HUGEINT) AS c FROM positions)
SELECT n AS total_holdings, CAST(e AS DOUBLE) / 100.0 AS total_equity,
  CAST(c AS DOUBLE) / 100.0 AS total_cost_basis,
  CAST(e - c AS DOUBLE) / 100.0 AS unrealized_pl,
  CAST({half_up('((e - c) * 10000)', 'c')} AS DOUBLE) / 100.0 AS unrealized_pct
FROM sums""", "holdings")

add("l04_leaders", lambda s, d: portfolio.leaders(positions(s, d), 5), f"""
WITH {POSITIONS_SQL}, ranked AS (
  SELECT 'top' AS list_name, row_number() OVER (ORDER BY equity DESC, ticker) AS place, 5 AS n,
    ticker, equity, pct_change FROM positions
  UNION ALL SELECT 'gainer', row_number() OVER (ORDER BY pct_change DESC, ticker), 3, ticker,
    equity, pct_change FROM positions WHERE pct_change > 0
  UNION ALL SELECT 'loser', row_number() OVER (ORDER BY pct_change, ticker), 3, ticker, equity,
    pct_change FROM positions WHERE pct_change < 0)
SELECT list_name, CAST(place AS INTEGER) AS place, ticker, CAST(equity AS DOUBLE) AS equity,
  CAST(pct_change AS DOUBLE) AS pct_change FROM ranked WHERE place <= n""", "holdings")


def stock_context(spark, sf_dir):
    """Every part asked for as a ticker; two thirds of them are held."""
    asked = holdings(spark, sf_dir).select("ticker")
    held = positions(spark, sf_dir).filter(~F.col("ticker").endswith("7"))
    sector = F.substring("ticker", -1, 1)
    info = holdings(spark, sf_dir).select(
        F.upper("ticker").alias("ticker"), F.col("name").alias("company_name"),
        F.concat(F.lit("sector "), sector).alias("industry"))
    headlines = holdings(spark, sf_dir).select(
        F.explode(F.array(F.upper("ticker"), F.concat(F.lit("sector "), sector))).alias("topic"),
        F.concat(F.lit("about "), "name").alias("headline"), F.col("quantity").alias("place"))
    macro = holdings(spark, sf_dir).agg(F.max("ticker").alias("last_ticker"))
    found = as_doubles(portfolio.context(asked, held, info, headlines, macro))
    return found.withColumns({c: F.array_join(c, "; ") for c in ("company_news", "industry_news")})


add("j09_stock_context", stock_context, f"""
WITH {POSITIONS_SQL}, held AS (SELECT * FROM positions WHERE ticker NOT LIKE '%7')
SELECT upper(a.ticker) AS ticker, h.ticker IS NOT NULL AS held,
  CAST(h.quantity AS DOUBLE) AS quantity, CAST(h.avg_cost AS DOUBLE) AS avg_cost,
  CAST(h.current_price AS DOUBLE) AS current_price, CAST(h.equity AS DOUBLE) AS equity,
  CAST(h.pct_change AS DOUBLE) AS pct_change, a.name AS company_name,
  'sector ' || right(a.ticker, 1) AS industry, 'about ' || a.name AS company_news,
  n.news AS industry_news, (SELECT max(ticker) FROM holdings) AS last_ticker
FROM holdings a LEFT JOIN held h ON a.ticker = h.ticker JOIN (
  SELECT k, string_agg('about ' || name, '; ' ORDER BY n) AS news FROM (
    SELECT right(ticker, 1) AS k, name, row_number() OVER (
      PARTITION BY right(ticker, 1) ORDER BY quantity, 'about ' || name) AS n FROM holdings)
  WHERE n <= 3 GROUP BY k) n ON n.k = right(a.ticker, 1)""", "holdings")


def context_as_of(spark, sf_dir):
    """A ticker and a day per ledger row, with the indicators and price known on that day.

    Indicators come on every ninth day of the ledger, prices with every eleventh row, so most days have
    neither and some tickers wait long for their first price.
    """
    rows = ledger(spark, sf_dir)
    ticker = F.concat(F.lit("T"), (F.col("id") % 400).cast("string")).alias("ticker")
    asked = rows.select(ticker, "date")
    macro = rows.filter("datediff(date, DATE '1990-01-01') % 9 = 0").groupBy("date").agg(
        F.count(F.lit(1)).alias("n_rows"), dollars(F.max("amount")).alias("largest"))
    prices = rows.filter("id % 11 = 0").select(ticker, "date", F.col("amount").alias("price"))
    held = positions(spark, sf_dir).filter(F.lit(False))
    found = portfolio.context(asked, held, macro=macro, prices=prices)
    return found.select("ticker", "date", dollars(F.col("price")).alias("price"), "price_date",
                        "macro_date", "n_rows", "largest")


add("j09_context_as_of", context_as_of, """
WITH asked AS (SELECT DISTINCT 'T' || (id % 400) AS ticker, date FROM ledger),
macro AS (SELECT date AS macro_date, COUNT(*) AS n_rows, CAST(MAX(amount) AS DOUBLE) AS largest
  FROM ledger WHERE date_diff('day', DATE '1990-01-01', date) % 9 = 0 GROUP BY date),
prices AS (SELECT 'T' || (id % 400) AS ticker, date AS price_date, MAX(amount) AS price
  FROM ledger WHERE id % 11 = 0 GROUP BY ALL)
SELECT a.ticker, a.date, CAST(p.price AS DOUBLE) AS price, p.price_date, m.macro_date, m.n_rows, m.largest
FROM asked a ASOF LEFT JOIN prices p ON a.ticker = p.ticker AND a.date >= p.price_date
ASOF LEFT JOIN macro m ON a.date >= m.macro_date""", "ledger")

# ------------------------------------------------------------ windows over series
SERIES = """series AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day,
  CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2)"""


def daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(
        "event_type", F.col("ts").cast("date").alias("day")
    ).agg(dollars(F.sum(F.col("value").cast("decimal(18,2)"))).alias("total"))


def monthly_index(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(
        "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")
    ).agg(dollars(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).alias("total"))


def year_change(spark, sf_dir):
    changed = windows.change_over(monthly_index(spark, sf_dir), ["o_orderpriority"], "month",
                                  "total", 12)
    return windows.last_rows(changed, ["o_orderpriority"], ["month"], 1)


add("w06_year_over_year", year_change, """
WITH series AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1, 2),
changed AS (SELECT *, lag(total, 12) OVER (PARTITION BY o_orderpriority ORDER BY month) AS old,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY month DESC) AS rn FROM series)
SELECT o_orderpriority, month, total, (total - old) / old * 100 AS pct_change
FROM changed WHERE rn = 1""")

add("w07_five_day_change",
    lambda s, d: windows.change_over(daily(s, d), ["event_type"], "day", "total", 4), f"""
WITH {SERIES} SELECT event_type, day, total,
  (total - lag(total, 4) OVER w) / lag(total, 4) OVER w * 100 AS pct_change
FROM series WINDOW w AS (PARTITION BY event_type ORDER BY day)""")

# ------------------------------------------------------------ conversations
MODELS = list(fv.MODEL_PRICES) + ["unlisted"]


def usage_log(spark, sf_dir):
    """Assistant turns as calls: characters stand for tokens, models go round."""
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]),
                         (F.col("conv_id") % len(MODELS) + 1).cast("int"))
    return turns(spark, sf_dir).select(
        "conv_id", "turn", model.alias("model"), "text",
        F.when(F.col("role") == "assistant", 0).otherwise(F.col("n_chars")).cast("long")
        .alias("input_tokens"),
        F.when(F.col("role") == "assistant", F.col("n_chars")).otherwise(0).cast("long")
        .alias("output_tokens"),
    )


MODEL_LIST = ", ".join(f"'{m}'" for m in MODELS)
PRICES = ", ".join(f"('{m}', CAST({i!r} AS DOUBLE), CAST({o!r} AS DOUBLE))"
                   for m, (i, o) in fv.MODEL_PRICES.items())
USAGE = f"""prices(model, price_in, price_out) AS (VALUES {PRICES}),
calls AS (SELECT conv_id, turn, text, ([{MODEL_LIST}])[conv_id % {len(MODELS)} + 1] AS model,
  CAST(CASE WHEN role = 'assistant' THEN 0 ELSE n_chars END AS BIGINT) AS input_tokens,
  CAST(CASE WHEN role = 'assistant' THEN n_chars ELSE 0 END AS BIGINT) AS output_tokens
  FROM turns),
costed AS (SELECT calls.*, COALESCE(CAST(input_tokens AS DOUBLE) / 1000 * price_in
  + CAST(output_tokens AS DOUBLE) / 1000 * price_out, 0) AS cost_usd
  FROM calls LEFT JOIN prices USING (model))"""

add("j10_model_prices",
    lambda s, d: usage.with_cost(usage_log(s, d).drop("text")), f"""
WITH {USAGE} SELECT conv_id, turn, model, input_tokens, output_tokens, cost_usd
FROM costed""", "turns")

add("f43_call_cost",
    lambda s, d: usage.with_cost(usage_log(s, d)).select("conv_id", "turn", "cost_usd"), f"""
WITH {USAGE} SELECT conv_id, turn, cost_usd FROM costed""", "turns")


def usage_rollup(spark, sf_dir):
    rolled = usage.rollup(usage.with_cost(usage_log(spark, sf_dir)), ["model"])
    return rolled.withColumn("total_cost_usd", F.round("total_cost_usd", 6))


add("a35_usage_rollup", usage_rollup, f"""
WITH {USAGE} SELECT model, COUNT(*) AS total_calls,
  CAST(SUM(input_tokens) AS BIGINT) AS total_input_tokens,
  CAST(SUM(output_tokens) AS BIGINT) AS total_output_tokens,
  ROUND(SUM(cost_usd), 6) AS total_cost_usd
FROM costed GROUP BY model""", "turns")

RECENT = """recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
  ORDER BY turn DESC) AS rn FROM turns) WHERE rn <= 6)"""
add("w05_last_six_turns", lambda s, d: usage.recent_turns(turns(s, d)), f"""
WITH {RECENT} SELECT conv_id, turn, role, text, n_chars FROM recent""", "turns")

add("f42_prompt_text", lambda s, d: usage.prompts(turns(s, d)), f"""
WITH {RECENT} SELECT conv_id, COALESCE(string_agg(
  CASE role WHEN 'user' THEN 'User: ' || text WHEN 'assistant' THEN 'Assistant: ' || text
    WHEN 'tool' THEN 'Tool results: ' || text END, chr(10) || chr(10) ORDER BY turn), '')
  AS prompt FROM recent GROUP BY conv_id""", "turns")


def fenced(spark, sf_dir):
    """Replies as JSON tool calls: fenced, bare, with a nameless item, or plain text."""
    name = F.concat(F.lit("tool_"), F.col("role"))
    call = F.to_json(F.array(F.struct(name.alias("name"), F.create_map(
        F.lit("turn"), F.col("turn").cast("string")).alias("args"))))
    reply = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("```json\n"), call, F.lit("\n```")))
        .when(F.col("turn") % 4 == 1, call)
        .when(F.col("turn") % 4 == 2, F.lit('[{"args": {}}]'))
        .otherwise(F.col("text"))
    )
    return turns(spark, sf_dir).select("conv_id", "turn", reply.alias("reply"))


def tool_calls(spark, sf_dir):
    calls = conv.tool_calls(conv.strip_fence(F.col("reply")))
    return fenced(spark, sf_dir).select(
        "conv_id", "turn",
        F.size(calls).alias("n_calls"),
        F.get(calls, F.lit(0))["name"].alias("first_name"),
        F.get(calls, F.lit(0))["args"]["turn"].alias("first_arg"),
    )


add("f41_tool_calls", tool_calls, """
SELECT conv_id, turn, CAST(CASE WHEN turn % 4 < 2 THEN 1 ELSE 0 END AS INTEGER) AS n_calls,
  CASE WHEN turn % 4 < 2 THEN 'tool_' || role END AS first_name,
  CASE WHEN turn % 4 < 2 THEN CAST(turn AS VARCHAR) END AS first_arg FROM turns""", "turns")


def distinct_prompts(spark, sf_dir):
    calls = usage_log(spark, sf_dir).select(
        "model", F.lit(None).cast("string").alias("system"), F.col("text").alias("prompt"))
    return usage.distinct_prompts(calls)


add("f45_cache_keys", distinct_prompts, f"""
WITH {USAGE} SELECT sha256(model || '|||' || '' || '|||' || text) AS cache_key,
  COUNT(*) AS uses FROM calls GROUP BY 1""", "turns")

add("f44_first_present",
    lambda s, d: card_feed(s, d).select(
        "transaction_id", F.coalesce("merchant_raw", "name", "category").alias("label")), """
SELECT transaction_id, COALESCE(merchant_raw, name, category) AS label FROM card_feed""",
    "card_feed")
