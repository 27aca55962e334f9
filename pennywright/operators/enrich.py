"""Enrichment of raw ledger rows: merchant, category, confidence, flags."""

from pyspark.sql import DataFrame, functions as F

from pennywright.functions import fixed_values as fv, text
from pennywright.functions.fuzzy import with_best_alias
from pennywright.functions.matching import first_category
from pennywright.functions.money import zero
from pennywright.operators.joins import compute_once, not_yet_enriched
from pennywright.sources.scratch import written

THRESHOLD = 75
SHORTEST_FUZZY = 6
HINT_CAP = 0.85


def exact_merchant(cleaned, aliases=None):
    """First merchant, in list order, with an alias inside the cleaned text."""
    upper = {name: [a.upper() for a in words]
             for name, words in (aliases or fv.MERCHANT_ALIASES).items()}
    return first_category(cleaned, upper)


def fuzzy_list(aliases=None):
    """(alias, merchant) pairs long enough for fuzzy matching, in list order."""
    return [(alias.upper(), name) for name, words in (aliases or fv.MERCHANT_ALIASES).items()
            for alias in words if len(alias) >= SHORTEST_FUZZY]


def fuzzy_merchants(keys: DataFrame, aliases=None, threshold: float = THRESHOLD) -> DataFrame:
    """Match each distinct (cleaned, hint) fuzzily: the text first, then the hint."""
    pairs = fuzzy_list(aliases)
    words = [alias for alias, _ in pairs]
    names = F.array(*[F.lit(name) for _, name in pairs])

    def name_at(m):
        return F.get(names, m["position"])

    by_text = with_best_alias(keys, "cleaned", "_t", words, threshold)
    missed = F.when(F.col("_t.position").isNull(), F.upper(text.strip(F.col("hint"))))
    by_hint = with_best_alias(by_text.withColumn("_missed", missed), "_missed", "_h", words, threshold)
    return by_hint.select(
        *keys.columns,
        F.coalesce(name_at(F.col("_t")), name_at(F.col("_h"))).alias("fuzzy_name"),
        F.coalesce(
            F.col("_t.score") / 100.0,
            F.when(F.col("_h.score").isNotNull(),
                   F.least(F.col("_h.score") / 100.0, F.lit(HINT_CAP))),
        ).alias("fuzzy_score"),
        F.when(F.col("_t.position").isNotNull(), "fuzzy")
        .when(F.col("_h.position").isNotNull(), "hint")
        .alias("fuzzy_method"),
    )


def resolve_merchants(rows: DataFrame, key: str = "id", aliases=None,
                      threshold: float = THRESHOLD, **spread) -> DataFrame:
    """Add cleaned, merchant_name, merchant_score and method to rows.

    Cleaning and the search for known fragments cost far more than a row's bytes, so they are done
    once and written; what follows reads that.  Only rows without a known fragment are matched
    fuzzily, once per distinct text, and joined back.
    """
    columns = rows.columns
    cleaned = rows.withColumn("_raw", F.coalesce("description", F.lit(""))).withColumn(
        "cleaned", text.clean_card(F.col("_raw"))).withColumn(
        "_exact", exact_merchant(F.col("cleaned"), aliases))
    staged = written(cleaned.withColumn(
        "hint", F.when(F.col("_exact").isNull(), text.merchant_hint(F.col("_raw")))), "cleaned")
    known = staged.filter(F.col("_exact").isNotNull()).select(
        *columns, "cleaned", F.col("_exact").alias("merchant_name"), F.lit(1.0).alias("merchant_score"),
        F.lit("substring").alias("method"))
    rest = staged.filter(F.col("_exact").isNull()).drop("_exact")
    matched = compute_once(
        rest, ["cleaned", "hint"], lambda k: fuzzy_merchants(k, aliases, threshold), key, **spread
    )
    hint = text.strip(F.col("hint"))
    last_resort = F.when(F.length(hint) > 2, text.title_case(hint)).otherwise(
        text.first_word(F.col("cleaned"), F.col("_raw"))
    )
    guessed = matched.select(
        *columns, "cleaned",
        F.coalesce("fuzzy_name", last_resort).alias("merchant_name"),
        F.coalesce("fuzzy_score", F.lit(0.3)).alias("merchant_score"),
        F.coalesce("fuzzy_method", F.lit("fallback")).alias("method"),
    )
    return known.unionByName(guessed)


def taxonomy_pairs(taxonomy=None) -> dict:
    """merchant -> (category, subcategory); the later entry of a merchant counts."""
    return {merchant: (category, sub)
            for category, subs in (taxonomy or fv.CARD_TAXONOMY).items()
            for sub, merchants in subs.items() for merchant in merchants}


def taxonomy_frame(spark, taxonomy=None) -> DataFrame:
    rows = [(m, c, s) for m, (c, s) in taxonomy_pairs(taxonomy).items()]
    return spark.createDataFrame(rows, "merchant_name string, category string, subcategory string")


def categorise(rows: DataFrame, taxonomy=None) -> DataFrame:
    """Category, subcategory and confidence of resolved merchants.

    The taxonomy is a fixed list of some seventy rows, hence the broadcast.  An
    unknown merchant becomes Uncategorized / Other with confidence 0.2.
    """
    known = F.broadcast(taxonomy_frame(rows.sparkSession, taxonomy))
    joined = rows.join(known, "merchant_name", "left")
    return joined.withColumns({
        "confidence_score": F.when(F.col("category").isNull(), F.lit(0.2)).otherwise(
            F.col("merchant_score")
        ),
        "category": F.coalesce("category", F.lit("Uncategorized")),
        "subcategory": F.coalesce("subcategory", F.lit("Other")),
    })


def enrich_card(raw: DataFrame, aliases=None, taxonomy=None, threshold: float = THRESHOLD,
                **spread) -> DataFrame:
    """Raw card rows -> enriched rows keyed by raw_id."""
    rows = raw.select(
        "id", "statement_id", "bank_name", "date",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("amount", zero()).alias("amount"),
        F.coalesce("transaction_type", F.lit("UNKNOWN")).alias("transaction_type"),
        "balance",
    )
    done = categorise(resolve_merchants(rows, "id", aliases, threshold, **spread), taxonomy)
    return done.select(
        F.col("id").alias("raw_id"), "statement_id", "bank_name", "date", "description",
        F.col("cleaned").alias("clean_description"), "amount", "transaction_type", "balance",
        "merchant_name", F.col("description").alias("merchant_raw"), "category", "subcategory",
        text.location(F.col("description")).alias("location"),
        "confidence_score", F.col("method").alias("enrichment_method"),
        text.anomaly_flags(F.col("amount"), F.col("category")).alias("flags"),
    )


def enrich_bank(raw: DataFrame) -> DataFrame:
    """Raw bank rows -> enriched rows keyed by raw_id; one map-only pass."""
    rows = text.with_bank_category(raw.withColumns({
        "description": F.coalesce("description", F.lit("")),
        "amount": F.coalesce("amount", zero()),
        "transaction_type": F.coalesce("transaction_type", F.lit("UNKNOWN")),
    }))
    confidence = text.bank_confidence(F.col("category"))
    return rows.select(
        F.col("id").alias("raw_id"), "statement_id", "bank_name", "account_type", "date",
        "description", text.clean_bank(F.col("description")).alias("clean_description"),
        "amount", "transaction_type", "balance", "category",
        confidence.alias("confidence_score"),
        text.method_label(confidence).alias("enrichment_method"),
    )


def chosen_input(raw: DataFrame, statement_id=None, account_type: str = None) -> DataFrame:
    """Raw rows of one statement and/or one account type."""
    if statement_id is not None:
        raw = raw.filter(F.col("statement_id") == statement_id)
    if account_type:
        raw = raw.filter(F.col("account_type") == account_type)
    return raw


def pending_input(raw: DataFrame, enriched: DataFrame = None, reprocess: bool = False,
                  threshold: float = 0.0) -> DataFrame:
    """Rows still to be enriched; everything when reprocessing."""
    if reprocess or enriched is None:
        return raw
    return not_yet_enriched(raw, enriched, threshold)


def run_stats(raw: DataFrame, enriched: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row: raw rows, rows a run would process, skip, and cannot process (errors).

    A row without an id cannot be keyed in the enriched table; it is an error, as no other
    input makes enrichment fail.
    """
    done = enriched.filter(F.col("confidence_score") >= threshold).select(
        F.col("raw_id").alias("id"), F.lit(1).alias("_done")
    )
    return raw.select("id").join(done, "id", "left").agg(
        F.count(F.lit(1)).alias("total_raw"),
        F.count(F.when(F.col("_done").isNull() & F.col("id").isNotNull(), 1)).alias("processed"),
        F.count("_done").alias("skipped"),
        F.count(F.when(F.col("id").isNull(), 1)).alias("errors"),
    )


def taxonomy_size(rows: DataFrame) -> DataFrame:
    """Subcategories and merchants in use per category."""
    return rows.groupBy("category").agg(
        F.countDistinct("subcategory").alias("n_subcategories"),
        F.countDistinct("merchant_name").alias("n_merchants"),
    )
