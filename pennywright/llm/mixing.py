"""Mixing sources to target weights by hierarchical budgets, DataFrame functions only.

Documents sit in a tree domain -> language -> source.  Weights propagate from the
root: every node shares its token budget among its children in proportion to
their weights.  A child never gets more than its subtree can give (its tokens
times `epochs`); what it cannot take goes to its siblings, and only a node whose
children are all full leaves anything to its ancestors' other children.  Each
leaf then takes the longest prefix, in tokens, of its documents in a seeded
order; whole epochs come first, and each epoch has an order of its own.

Shares are whole tokens, rounded down.  The order of an epoch is the MD5 of
seed, epoch and doc_id; rows of one doc_id tie and are taken together or not.

Scale: the table is read once to narrow rows.  They shrink to one row per (leaf,
epoch, slice), where a slice is the first hex digits of the MD5; a prefix takes
whole slices, so only the slice with the cut is sorted, never a whole leaf.
What comes out is one last hash per leaf and epoch, and selecting rows is a
filter against it.

Defined results: null text has no tokens; documents without tokens are taken if they
come before the cut.  Null lang or source is a value of its own; a null doc_id orders
as the empty text.  Weights below 1 count as 1.  An empty table, or a leaf without
tokens, gives no rows.  `select_documents` keeps the columns of its input; working
columns are named `__mx_...`, so that no column of the input clashes.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pennywright.llm.shared import words_of, written

SLICE = 3  # hex digits: 4096 slices per leaf and epoch
LEVELS = ["domain", "lang", "source"]
LAST = "g"  # after every hex digest


def source_domain(source: Column) -> Column:
    """The domain of a source: its number modulo 4; sources without number are one domain."""
    number = F.nullif(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("domain"), (number.cast("long") % 4).cast("string")), F.lit("other"))


def default_weights() -> dict[str, Column]:
    """Whole-number weights: domains alike, English 3 against 2, sources alike."""
    return {
        "domain": F.lit(1),
        "lang": F.when(F.col("lang") == "en", F.lit(3)).otherwise(F.lit(2)),
        "source": F.lit(1),
    }


def narrow(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source and n_tokens (words), one row per row of `docs`."""
    domain = source_domain(F.col("source")) if domain is None else domain
    return docs.select("doc_id", domain.alias("domain"), "lang", "source",
                       F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"))


def _hash(epoch: Column, seed: str) -> Column:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), key))


def _by_epoch(rows: DataFrame, epochs: int, seed: str) -> DataFrame:
    """Every row once per epoch, with its hash there."""
    rows = rows.withColumn("__mx_epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    return rows.withColumn("__mx_hash", _hash(F.col("__mx_epoch"), seed))


def share(children: DataFrame, parent: list[str]) -> DataFrame:
    """Split each parent's __mx_budget among its children (__mx_cap, __mx_weight) as `got`.

    Children fill up in the order of capacity per weight.  With B left for those that
    are not yet full and W the sum of their weights, a child is full if its capacity is at
    most B * weight / W; the first that is not sets the level for the rest.
    """
    cap, weight = F.col("__mx_cap"), F.col("__mx_weight")
    order = Window.partitionBy(*(parent or [F.lit(0)])).orderBy(
        cap / weight, *[c for c in LEVELS if c in children.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = children.withColumns({
        "__mx_left": F.col("__mx_budget") - F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "__mx_open": F.sum(weight).over(after),
    })
    level = F.when(cap * F.col("__mx_open") > F.col("__mx_left") * weight,
                   F.struct("__mx_left", "__mx_open"))
    df = df.withColumn("__mx_level", F.first(level, ignorenulls=True).over(so_far))
    got = F.expr("(__mx_level.__mx_left * __mx_weight) div __mx_level.__mx_open")
    return df.withColumn("got", F.when(F.col("__mx_level").isNull(), cap).otherwise(got))


def budgets(rows: DataFrame, fraction: tuple[int, int], epochs: int,
            weights: dict[str, Column]) -> DataFrame:
    """Leaves with their tokens and the tokens granted: domain, lang, source, tokens, got.

    The root's budget is `fraction` (two whole numbers) of all tokens.  The frames here
    have a row per node of the tree.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    total = F.expr(f"(sum(tokens) OVER (PARTITION BY 0) * {fraction[0]}) div {fraction[1]}")
    nodes, parent = None, []
    for depth, level in enumerate(LEVELS):
        path = LEVELS[: depth + 1]
        kids = leaves.groupBy(*path).agg(F.sum("tokens").alias("tokens")).withColumns({
            "__mx_cap": F.col("tokens") * epochs,
            "__mx_weight": F.greatest(weights[level].cast("long"), F.lit(1)),
        })
        if nodes is None:
            kids = kids.withColumn("__mx_budget", F.least(
                total, F.sum("__mx_cap").over(Window.partitionBy(F.lit(0)))))
        else:
            up = nodes.select(*[F.col(c).alias(f"__mx_{c}") for c in parent],
                              F.col("got").alias("__mx_budget"))
            kids = kids.join(up, [F.col(c).eqNullSafe(F.col(f"__mx_{c}")) for c in parent])
        nodes, parent = share(kids, parent), path
    return nodes.select(*LEVELS, "tokens", "got")


def last_hashes(rows: DataFrame, fraction: tuple[int, int], epochs: int, seed: str,
                weights: dict[str, Column] | None = None) -> DataFrame:
    """Per leaf and epoch with a budget, the last hash taken, over rows of `narrow`.

    Columns __mx_domain, __mx_lang, __mx_source, __mx_epoch, __mx_last.
    """
    keyed = _by_epoch(rows, epochs, seed).withColumn(
        "__mx_slice", F.substring("__mx_hash", 1, SLICE))
    keys = [*LEVELS, "__mx_epoch"]
    slices = keyed.groupBy(*keys, "__mx_slice").agg(F.sum("n_tokens").alias("__mx_tokens"))
    granted = budgets(rows, fraction, epochs, weights or default_weights())
    used = (F.col("__mx_e") - 1) * F.col("tokens")
    room = F.greatest(F.least(F.col("got") - used, F.col("tokens")), F.lit(0))
    granted = granted.withColumn(
        "__mx_e", F.explode(F.sequence(F.lit(1), F.lit(epochs)))
    ).select(*[F.col(c).alias(f"__mx_{c}") for c in LEVELS], "__mx_e", room.alias("__mx_room"))
    granted = written(granted.filter("__mx_room > 0"), "mixing-budgets")
    same = [F.col(c).eqNullSafe(F.col(f"__mx_{c}")) for c in LEVELS] + [
        F.col("__mx_epoch") == F.col("__mx_e")]
    up_to = Window.partitionBy(*keys).orderBy("__mx_slice")
    cut = (
        slices.withColumn("__mx_sum", F.sum("__mx_tokens").over(up_to))
        .join(granted, same)
        .filter("__mx_sum > __mx_room")
        .groupBy(*[f"__mx_{c}" for c in LEVELS], "__mx_e", "__mx_room")
        .agg(F.min_by(F.struct("__mx_slice", (F.col("__mx_sum") - F.col("__mx_tokens"))
                               .alias("__mx_before")), "__mx_slice").alias("__mx_cut"))
        .select("*", "__mx_cut.*").drop("__mx_cut")
    )
    cut = written(cut, "mixing-cuts").withColumnRenamed("__mx_slice", "__mx_at")
    inside = Window.partitionBy(*keys).orderBy("__mx_hash")
    taken = (
        keyed.join(cut, [*same, F.col("__mx_slice") == F.col("__mx_at")])
        .withColumn("__mx_sum", F.col("__mx_before") + F.sum("n_tokens").over(inside))
        .filter("__mx_sum <= __mx_room")
        .groupBy(*[f"__mx_{c}" for c in LEVELS], "__mx_e")
        .agg(F.max("__mx_hash").alias("__mx_in_slice"))
    )
    names = [f"__mx_{c}" for c in LEVELS] + ["__mx_e"]
    def joined(left, right, columns):
        right = right.select(*[F.col(n).alias(f"{n}_r") for n in names], *columns)
        on = [F.col(n).eqNullSafe(F.col(f"{n}_r")) for n in names]
        return left.join(right, on, "left").drop(*[f"{n}_r" for n in names])
    out = joined(granted, cut, ["__mx_at"])
    out = joined(out, taken, ["__mx_in_slice"])
    # nothing of the cut slice: everything below the slice's own digits
    last = F.when(F.col("__mx_at").isNull(), F.lit(LAST)).otherwise(
        F.coalesce("__mx_in_slice", "__mx_at"))
    return written(out.select(*[f"__mx_{c}" for c in LEVELS], F.col("__mx_e"),
                              last.alias("__mx_last")), "mixing-last")


def _taken(rows: DataFrame, last: DataFrame, epochs: int, seed: str) -> DataFrame:
    """Rows (with doc_id and the three levels) once per epoch that takes them."""
    keyed = _by_epoch(rows, epochs, seed)
    same = [F.col(c).eqNullSafe(F.col(f"__mx_{c}")) for c in LEVELS] + [
        F.col("__mx_epoch") == F.col("__mx_e")]
    return keyed.join(last, same).filter("__mx_hash <= __mx_last")


def mix(docs: DataFrame, fraction: tuple[int, int] = (1, 2), epochs: int = 2,
        seed: str = "mix-1", weights: dict[str, Column] | None = None,
        domain: Column | None = None) -> DataFrame:
    """The mixture as ids: doc_id, domain, lang, source, n_tokens, epoch per selected copy."""
    rows = written(narrow(docs, domain), "mixing-rows")
    last = last_hashes(rows, fraction, epochs, seed, weights)
    return _taken(rows, last, epochs, seed).select(
        "doc_id", *LEVELS, "n_tokens", F.col("__mx_epoch").alias("epoch"))


def select_documents(docs: DataFrame, fraction: tuple[int, int] = (1, 2), epochs: int = 1,
                     seed: str = "mix-1", weights: dict[str, Column] | None = None,
                     domain: Column | None = None) -> DataFrame:
    """The mixture as documents: rows of `docs`, repeated for further epochs."""
    rows = written(narrow(docs, domain), "mixing-rows")
    last = last_hashes(rows, fraction, epochs, seed, weights)
    domain = source_domain(F.col("source")) if domain is None else domain
    whole = docs.select(F.struct(*docs.columns).alias("__mx_row"), "doc_id", "lang", "source",
                        domain.alias("domain"))
    return _taken(whole, last, epochs, seed).select("__mx_row.*")
