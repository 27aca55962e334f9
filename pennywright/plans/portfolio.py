"""Named queries over investment positions.

A holdings frame has ticker, name, quantity, avg_cost, current_price, equity
and pct_change.
"""

from pyspark.sql import DataFrame, Window, functions as F

from pennywright.functions.money import dollars
from pennywright.operators.asof import asof_join
from pennywright.plans.registry import named

SORTS = ("equity", "ticker", "pct_change", "quantity")


@named("portfolio.holdings")
def holdings(positions: DataFrame, sort_by: str = "equity") -> DataFrame:
    """All positions; the ticker sorts upwards, numbers downwards."""
    key = sort_by if sort_by in SORTS else "equity"
    order = F.asc(key) if key == "ticker" else F.desc(key)
    return positions.orderBy(order, "ticker")


@named("portfolio.by_ticker")
def by_ticker(positions: DataFrame, ticker: str) -> DataFrame:
    return positions.filter(F.upper("ticker") == ticker.strip().upper())


@named("portfolio.not_held")
def not_held(positions: DataFrame, ticker: str) -> DataFrame:
    """No rows when the ticker is held; else one row per ticker that is, sorted.

    The held tickers come as rows, so no task has to hold the whole list.
    """
    wanted = ticker.strip().upper()
    found = positions.agg(
        F.coalesce(F.bool_or(F.upper("ticker") == wanted), F.lit(False)).alias("found")
    )
    missing = found.filter(~F.col("found")).select(
        F.lit(f"Ticker '{wanted}' not found in portfolio.").alias("error")
    )
    held = positions.select(F.col("ticker").alias("held_ticker"), F.lit(1).alias("_one"))
    return (
        held.join(F.broadcast(missing.withColumn("_one", F.lit(1))), "_one")
        .select("error", "held_ticker")
        .orderBy("held_ticker")
    )


@named("portfolio.summary")
def summary(positions: DataFrame) -> DataFrame:
    cost = F.sum(F.col("quantity") * F.col("avg_cost"))
    equity = F.sum("equity")
    pct = F.coalesce((equity - cost) / F.nullif(cost, F.lit(0)) * 100, F.lit(0))
    return positions.agg(
        F.count(F.lit(1)).alias("total_holdings"),
        dollars(F.round(equity, 2)).alias("total_equity"),
        dollars(F.round(cost, 2)).alias("total_cost_basis"),
        dollars(F.round(equity - cost, 2)).alias("unrealized_pl"),
        dollars(F.round(pct, 2)).alias("unrealized_pct"),
    )


@named("portfolio.leaders")
def leaders(positions: DataFrame, top_n: int = 5) -> DataFrame:
    """Largest positions, best three gainers and worst three losers, ranked."""
    def ranked(df, list_name, order, n):
        best = df.orderBy(order, "ticker").limit(n)
        place = F.row_number().over(Window.partitionBy("list_name").orderBy(order, "ticker"))
        return best.withColumn("list_name", F.lit(list_name)).withColumn("place", place)

    change = F.col("pct_change")
    return (
        ranked(positions, "top", F.desc("equity"), top_n)
        .unionByName(ranked(positions.filter(change > 0), "gainer", F.desc("pct_change"), 3))
        .unionByName(ranked(positions.filter(change < 0), "loser", F.asc("pct_change"), 3))
        .select("list_name", "place", "ticker", dollars(F.col("equity")).alias("equity"),
                dollars(change).alias("pct_change"))
    )


def top_headlines(headlines: DataFrame, news_count: int) -> DataFrame:
    """topic and its first `news_count` headlines by place, as one short list per topic."""
    by = Window.partitionBy("topic").orderBy("place", "headline")
    best = headlines.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= news_count)
    return best.groupBy("topic").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_n", "headline"))), lambda x: x["headline"]
    ).alias("news"))


def macro_row(macro: DataFrame, as_of=None) -> DataFrame:
    """One row: the newest indicators on or before `as_of` (any day); null ones if there are none."""
    row = F.struct(*macro.columns)
    if "date" not in macro.columns:
        return macro.agg(F.max(row).alias("row"))
    if as_of is not None:
        macro = macro.filter(F.col("date") <= F.lit(as_of).cast("date"))
    return macro.agg(F.max_by(row, F.struct("date", row)).alias("row"))


@named("portfolio.context")
def context(requests: DataFrame, positions: DataFrame, info: DataFrame = None,
            headlines: DataFrame = None, macro: DataFrame = None,
            news_count: int = 3, prices: DataFrame = None, as_of=None) -> DataFrame:
    """Requested tickers with held flag, position and landed company data, a row per ticker.

    `info` has ticker, company_name, industry; `headlines` topic (a ticker or an
    industry), headline and place; `macro` indicators by `date` (or one row without); `prices`
    ticker, date and price.  Requests with a `date` of their own get a row per ticker and date, with
    the indicators and price known on that day; others those known on `as_of`.

    Frames that grow with the tickers are joined by sorting: their files are many times smaller than
    their rows, so that Spark would send them whole to every task.  A hot industry is split by
    adaptive execution.
    """
    dated = "date" in requests.columns
    wanted = requests.select(
        F.upper(F.trim("ticker")).alias("ticker"), *(["date"] if dated else [])).distinct()
    mine = positions.withColumn("ticker", F.upper("ticker"))
    result = wanted.join(
        mine.select("ticker", F.lit(True).alias("held"), "quantity", "avg_cost",
                    "current_price", "equity", "pct_change").hint("merge"),
        "ticker", "left",
    ).withColumn("held", F.coalesce("held", F.lit(False)))
    if info is not None:
        result = result.join(info.hint("merge"), "ticker", "left")
    if headlines is not None:
        news = top_headlines(headlines, news_count)
        none = F.array().cast("array<string>")
        for key, name in (("ticker", "company_news"), ("industry", "industry_news")):
            if key in result.columns:
                about = news.select(F.col("topic").alias(key), F.col("news").alias(name)).hint("merge")
                result = result.join(about, key, "left").withColumn(
                    name, F.coalesce(name, none))
    if prices is not None:
        quoted = prices.select(F.upper(F.trim("ticker")).alias("ticker"), "date", "price")
        if dated:
            result = asof_join(result, quoted, ["ticker"], "date", "_price")
        else:
            if as_of is not None:
                quoted = quoted.filter(F.col("date") <= F.lit(as_of).cast("date"))
            newest = F.struct("date", "price")
            result = result.join(quoted.groupBy("ticker").agg(F.max(newest).alias("_price")).hint("merge"), "ticker", "left")
        result = result.withColumns({
            "price": F.col("_price.price"), "price_date": F.col("_price.date")}).drop("_price")
    if macro is not None:
        if dated and "date" in macro.columns:
            result = asof_join(result, macro, [], "date", "_macro")
        else:
            result = result.withColumn("_macro", macro_row(macro, as_of).scalar())
        names = {c: "macro_date" if c == "date" else c for c in macro.columns}
        result = result.withColumns(
            {n: F.col("_macro")[c] for c, n in names.items()}).drop("_macro")
    return result
