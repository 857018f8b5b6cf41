"""The registered corpus queries, each over its whole table with production
parameters, and their DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, common, digests, exact_dedup, lang_id, lexical, line_dedup, mixing, ngram_join, oracle_sql, packing, periodic, repeats, token_count, token_shards

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Rows an Arrow batch carries to a Python worker; long texts make rows large.
BATCH_ROWS = 1000


def set_batch_rows(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        set_batch_rows(spark)
        return fn(spark, sf_dir)

    REGISTRY[fn.__name__] = run
    return run


@query
def op1_line_dedup(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query
def op4_mixing(spark, sf_dir):
    mixed = mixing.mix(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


@query
def op2_ngram_join(spark, sf_dir):
    return ngram_join.components(common.table(spark, sf_dir, "documents"), n=4, percent=85)


@query
def op3_token_shards(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_shards.materialise(docs, common.shared_path(spark, "shards"))


@query
def op5_nearest(spark, sf_dir):
    return ann.nearest(common.table(spark, sf_dir, "embeddings"))


@query
def op6_packing(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs)


@query
def op7_repeats(spark, sf_dir):
    return repeats.repeated_passages(common.table(spark, sf_dir, "documents"))


@query
def op8_token_count(spark, sf_dir):
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_language_id(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    model = lang_id.fit(docs)
    both = lang_id.from_documents(docs).unionByName(lang_id.from_pages(common.table(spark, sf_dir, "pages")), allowMissingColumns=True)
    return lang_id.identify(both, model, ["doc_id", "page_id", "declared", "host"])


@query
def op10_exact_dedup(spark, sf_dir):
    out = exact_dedup.exact_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op11_fingerprint(spark, sf_dir):
    return digests.with_edits(common.table(spark, sf_dir, "documents"))


@query
def op12_periodic_runs(spark, sf_dir):
    found = periodic.periodic_runs(common.table(spark, sf_dir, "documents"), edit=periodic.repeat_tail)
    best = periodic.strongest(F.col("runs"))
    light = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                         periodic.runs_digest(F.col("runs")).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * best.length) DIV best.period").alias("exponent_milli")
    return light.select("doc_id", "n_runs", "best.*", exponent, "runs_sha256", "collapsed_sha256")


@query
def op13_lexical_search(spark, sf_dir):
    return lexical.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def registered() -> dict[str, str]:
    return dict(oracle_sql.SQL)
