"""Corpus preparation as stored stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
its result is written to the shared folder and read again as the next one's
input.  All but the last return the columns of ``documents``; the last returns
the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracehound.llm import catalog, common, lang_id, line_dedup, mixing, ngram_join, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rows without a recognisable language go.  The text model
    is fitted on the rows' own labels.  A row is named by its id and a hash
    of its text, so rows that share an id are judged one by one."""
    docs = docs.select(COLUMNS)
    named = lang_id.from_documents(docs).withColumn("text_hash", F.xxhash64("text"))
    # stored before the filter, which would otherwise be computed from the texts' evidence again
    judged = common.stash(lang_id.identify(named, lang_id.fit(docs), ["doc_id", "text_hash"]), "judged")
    out = judged.where("NOT kept").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    same = docs.doc_id.eqNullSafe(F.col("d")) & (F.xxhash64(docs.text) == F.col("h"))
    return docs.join(common.bounded(out, 32), same, "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: long lines that many documents hold stay in one of them."""
    out = line_dedup.dedup_lines(docs.select(COLUMNS))
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, 0.8): of each group of linked rows one
    row stays, that of the smallest id (null ids last; of several rows of this
    id, the one with the smallest text hash).

    Rows are judged by themselves, not by their id: they are numbered once and
    stored so (numbers given while reading would not survive another split of
    the files).  So a row is never removed because it shares the id of a copy,
    repeated rows are a group, and so are rows without an id.  Rows without
    words are in no group: all stay."""
    numbered = common.stash(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered-rows", "zstd")
    found = ngram_join.components(numbered, n=5, percent=80, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text_hash"), "row").alias("rank")
    ranked = common.stash(numbered.select("row", rank).join(found, "row"), "ranked-rows")
    groups = ranked.groupBy("component_id").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = common.stash(groups.select("component_id", F.col("first.row").alias("stays")), "near-copies")
    gone = ranked.join(common.bounded(groups, 24), "component_id").where("row <> stays").select("row")
    return numbered.join(common.bounded(gone, 16), "row", "left_anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as its source's target asks."""
    return mixing.emit(mixing.mix(docs.select(COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048 tokens."""
    return packing.pack_documents(docs.select(COLUMNS))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]
#: A fitted language model and a tokenizer take part: no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog.set_batch_rows(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
