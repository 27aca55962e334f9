"""One enrichment run: what is pending, enriched, merged into the table, counted."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from pennywright.operators import enrich, joins, pairing, tables


@dataclass
class Run:
    table: DataFrame  # the enriched table after the run
    stats: DataFrame  # one row: total_raw, processed, skipped, errors


def _finished(raw: DataFrame, enriched: DataFrame, fresh, threshold: float,
              reprocess: bool, upsert) -> Run:
    before = enriched.limit(0) if reprocess else enriched
    stats = enrich.run_stats(raw, before, threshold)
    pending = enrich.pending_input(raw, enriched, reprocess, threshold)
    new = fresh(pending.filter("id IS NOT NULL"))
    return Run(upsert(enriched, new.select(*[c for c in enriched.columns if c in new.columns])), stats)


def card(raw: DataFrame, enriched: DataFrame, statement_id=None, reprocess: bool = False,
         threshold: float = 0.0, aliases=None, taxonomy=None) -> Run:
    """Enrich card rows that are not in `enriched` yet (or all, when reprocessing).

    On a known raw_id only the enrichment columns change.
    """
    return _finished(
        enrich.chosen_input(raw, statement_id), enriched,
        lambda rows: enrich.enrich_card(rows, aliases, taxonomy), threshold, reprocess,
        tables.upsert_enrichment)


def bank(raw: DataFrame, enriched: DataFrame, statement_id=None, account_type: str = None,
         reprocess: bool = False, threshold: float = 0.0) -> Run:
    """The same for bank rows, which replace a known row whole."""
    return _finished(
        enrich.chosen_input(raw, statement_id, account_type), enriched, enrich.enrich_bank,
        threshold, reprocess, tables.upsert_rows)


def mirrored(enriched: DataFrame, left_statements: DataFrame, right_statements: DataFrame,
             left_rows: DataFrame, right_rows: DataFrame, mirror: DataFrame) -> DataFrame:
    """Enriched bank rows under the ids of a second store, merged into its table.

    Statements meet by file hash, rows by their natural key in order; rows without a partner stay
    out, as the second store does not know them.
    """
    statements = joins.registry_map(left_statements, right_statements)
    pairs = pairing.pair_in_order(left_rows, right_rows, statements).filter(
        "right_id IS NOT NULL")
    moved = enriched.join(pairs, enriched.raw_id == pairs.left_id).drop("left_id", "raw_id")
    return tables.upsert_rows(mirror, moved.withColumnRenamed("right_id", "raw_id"))
