"""URL filtering by fixed host/path rules and mined association rules.

Fixed rules come first: a rule `host/path` fits its host and all subdomains where the URL's path
starts with the rule's path; the longest rule wins.  Other URLs are judged by association
rules: Spark's FP-growth mines combinations of URL tokens (host labels, host suffixes, path
segments, query keys, scheme) together with the label of the page; rules "tokens -> bad" are
kept above a support and a confidence and dropped if a part of their tokens does as well.
A URL is blocked if some rule's tokens are all among its own.  Rules are looked up by an
inverted index that files each rule under its rarest token.

Scale: mining is Spark's distributed FP-growth over the labelled pages, and rules are pruned as
a frame; every rule that is left counts.  Up to INDEX_RULES of them go to the executors
as an index, and judging is one pass over the pages without a shuffle.  More are joined
to the tokens of the distinct token lists, and what they hit is joined back to the pages.

Defined results: a null URL, or one without `://`, has empty host and path and no tokens, so no
rule fits and it is allowed.  Repeated rows are judged each; a null page_id has no label;
repeated labels of a page count as bad if one of them is.  Without labels nothing is mined.  An
empty table gives no rows.  Other columns are left out.
"""

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pennywright.llm.shared import lower_ascii, small, written

#: The rules of the query contract, in its order.
FIXED_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
MIN_SUPPORT = 0.0005  # share of the labelled pages
MIN_PAGES = 5  # labelled pages that a rule must hold for, at least
MIN_CONFIDENCE = 0.5
MAX_TOKENS = 4  # of a rule
INDEX_RULES = 20_000  # beyond, rules are joined instead of sent as an index
BAD = "label=bad"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    rest = F.substring_index(_after(url), "/", 1)
    return lower_ascii(F.substring_index(F.substring_index(rest, "?", 1), "#", 1))


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to `?`, `#` or the end."""
    rest = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    at = F.locate("/", rest)
    return F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise(F.lit(""))


def fixed_rule(host: Column, path: Column, rules) -> Column:
    """Struct of the longest fitting rule and its verdict; null if none fits."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(
            "/" + rule_path)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL; empty for a URL without host."""
    labels = F.split(host, "[.]")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("^[0-9]+([.][a-z]+)?$"))
    query = F.when(F.locate("?", url) > 0, F.split(F.substring_index(
        F.substring_index(url, "#", 1), "?", -1), "&"))
    keys = F.transform(F.coalesce(query, F.array().cast("array<string>")),
                       lambda x: F.substring_index(x, "=", 1))
    tagged = F.concat(
        F.array(F.concat(F.lit("scheme="), lower_ascii(F.substring_index(url, "://", 1)))),
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
        F.array(F.concat(F.lit("site="), F.substring_index(host, ".", -2)),
                F.concat(F.lit("full="), host)),
        F.transform(parts, lambda x: F.concat(F.lit("path="), x)),
        F.transform(keys, lambda x: F.concat(F.lit("key="), x)),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.coalesce(tagged, F.array().cast("array<string>"))))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, tokens."""
    df = pages.select("page_id", "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
                      F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    return df.withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))


@dataclass(frozen=True)
class MinedRule:
    tokens: frozenset
    confidence: float
    pages: int


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT,
         min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules "tokens -> bad" from rows (tokens, bad): tokens (sorted), confidence, pages."""
    from pyspark.ml.fpm import FPGrowth

    total = labelled.count()
    if not total:
        return labelled.sparkSession.createDataFrame(
            [], "tokens array<string>, confidence double, pages long")
    baskets = labelled.select(F.when(
        F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    support = max(min_support, MIN_PAGES / total)
    model = FPGrowth(itemsCol="items", minSupport=min(support, 1.0)).fit(baskets)
    # mined once: the model's frame is made anew each time it is read
    found = written(model.freqItemsets.select(
        F.array_sort(F.array_remove("items", BAD)).alias("tokens"),
        F.array_contains("items", BAD).alias("bad"), "freq",
    ).filter((F.size("tokens") > 0) & (F.size("tokens") <= MAX_TOKENS)), "url-itemsets")
    rules = found.filter("bad").select("tokens", F.col("freq").alias("pages")).join(
        found.filter("NOT bad").select("tokens", "freq"), "tokens")
    rules = rules.select("tokens", (F.col("pages") / F.col("freq")).alias("confidence"), "pages")
    return pruned_frame(written(rules.filter(F.col("confidence") >= min_confidence), "url-rules"))


def pruned_frame(rules: DataFrame) -> DataFrame:
    """`pruned` of a written frame of rules."""
    parts = F.when(F.size("tokens") > 1, F.expr(
        "transform(sequence(1, shiftleft(1, size(tokens)) - 2), "
        "m -> filter(tokens, (t, i) -> (shiftright(m, i) & 1) = 1))"))
    parts = rules.select("tokens", "confidence", F.explode(parts).alias("part"))
    best = small(rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("best")))
    gone = parts.join(best, "part").filter("best >= confidence").select("tokens").distinct()
    return rules.join(gone, "tokens", "left_anti")


def pruned(rules: list[MinedRule]) -> list[MinedRule]:
    """Without rules that have a part which is a rule of at least their confidence."""
    best = {r.tokens: r.confidence for r in rules}
    kept = []
    for rule in sorted(rules, key=lambda r: len(r.tokens)):
        parts = _parts(sorted(rule.tokens))
        if not any(best.get(p, -1.0) >= rule.confidence for p in parts):
            kept.append(rule)
    return kept


def _parts(tokens: list[str]):
    """Proper non-empty subsets of at most MAX_TOKENS tokens."""
    for mask in range(1, 2 ** len(tokens) - 1):
        yield frozenset(t for i, t in enumerate(tokens) if mask >> i & 1)


def index_of(rules: list[MinedRule]) -> dict[str, list[frozenset]]:
    """Rules under their rarest token."""
    seen: dict[str, int] = {}
    for rule in rules:
        for token in rule.tokens:
            seen[token] = seen.get(token, 0) + 1
    index: dict[str, list[frozenset]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (seen[t], t)), []).append(rule.tokens)
    return index


def _hit_by_index(urls: DataFrame, mined: DataFrame) -> DataFrame:
    """Add column mined: whether a rule's tokens are all among those of the row."""
    index = index_of([MinedRule(frozenset(r.tokens), r.confidence, r.pages) for r in mined.collect()])

    @F.pandas_udf("boolean")
    def hit(tokens: pd.Series) -> pd.Series:
        out = []
        for own in tokens:
            own = set(own)
            out.append(any(rule <= own for t in own for rule in index.get(t, ())))
        return pd.Series(out, dtype=bool)

    return urls.withColumn("mined", hit("tokens"))


def _hit_by_join(urls: DataFrame, mined: DataFrame) -> DataFrame:
    """The same for any number of rules."""
    rules = mined.select(F.col("tokens").alias("rule"))
    each = rules.select("rule", F.explode("rule").alias("token"))
    seen = each.groupBy("token").count()  # frequent tokens only
    filed = written(each.join(small(written(seen, "url-tokens")), "token").groupBy("rule").agg(
        F.min(F.struct("count", "token"))["token"].alias("token")), "url-index")
    lists = urls.select("tokens").distinct()
    hits = lists.select("tokens", F.explode("tokens").alias("token")).join(
        small(filed), "token").filter(F.size(F.array_except("rule", "tokens")) == 0)
    hits = hits.select("tokens").distinct().withColumn("mined", F.lit(True))
    return urls.join(hits, "tokens", "left").withColumn("mined", F.coalesce("mined", F.lit(False)))


def judge(pages: DataFrame, labels: DataFrame, rules=FIXED_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages`.

    A page's label is that of the document with its id; bad is quality 0 or toxic 1.
    """
    urls = parsed(pages)
    bad = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    mined = written(mine(urls.join(bad, "page_id").select("tokens", "bad")), "url-pruned")
    hit = _hit_by_index if mined.count() <= INDEX_RULES else _hit_by_join
    df = hit(urls, mined).withColumn("found", fixed_rule(F.col("host"), F.col("path"), rules))
    return df.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(F.col("mined"), F.lit("block"))
                   .otherwise(F.lit("allow"))).alias("verdict"))
