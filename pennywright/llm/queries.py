"""One query per operator over its whole table, with DuckDB SQL where there is some."""

from pennywright.llm import (
    filter_audit, html_text, language_model, mixing, ngram_join, packing, personal_data,
    quality_classifier, quality_rules, sql, suffix_dedup, url_filters, vector_codes, winnowing,
)
from pennywright.llm.shared import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


@query("op2_quality_rules", sql.QUALITY_RULES)
def op2(spark, sf_dir):
    return quality_rules.measure(table(spark, sf_dir, "documents"))


@query("op10_mixing", sql.MIXING)
def op10(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False)


@query("op9_fingerprints")
def op9(spark, sf_dir):
    return winnowing.compare_edited(table(spark, sf_dir, "documents"))


@query("op5_quality_classifier")
def op5(spark, sf_dir):
    return quality_classifier.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_url_filters")
def op4(spark, sf_dir):
    return url_filters.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op6_html_text")
def op6(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op1_ngram_join", sql.NGRAM_JOIN)
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ngram_join.join_groups(docs, n=3, num=90, den=100)


@query("op3_lm_scoring")
def op3(spark, sf_dir):
    return language_model.score_documents(table(spark, sf_dir, "documents"))


@query("op7_suffix_dedup")
def op7(spark, sf_dir):
    return suffix_dedup.digest_repeats(table(spark, sf_dir, "documents"))


@query("op13_filter_audit", sql.FILTER_AUDIT)
def op13(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_vector_codes", sql.VECTOR_CODES)
def op11(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query("op12_personal_data")
def op12(spark, sf_dir):
    return personal_data.digest(table(spark, sf_dir, "documents"))
