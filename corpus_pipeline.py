"""From raw documents to packed training sequences: five stages, each on all that the stage before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read back before the next
stage. All but the last return the columns of ``docs`` (extra ones too, whatever their names). Empty tables pass through.
Rows are told apart by id and text, so ids may repeat or be null; rows equal in both are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseloom.llm import decontaminate, neardup, packing, pii, quality
from pulseloom.llm.common import documents, stored

SIMILARITY_PERCENT = 80  # shared five-word shingles from which two documents are near duplicates


def _unused(docs: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``docs`` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and key (of id and text) are in ``gone``."""
    id_, key = _unused(docs, "_gone_id", "_gone_key")
    out = gone.select(F.col("doc_id").alias(id_), F.col("_gone_key").alias(key))
    return docs.join(out, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("doc_id", "text") == F.col(key)), "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble takes for good; it learns from labelled rows that are not held out."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, = _unused(docs, "_score")
    scored = quality.scored(docs, model, docs.columns, score_col=score)
    return scored.filter(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Rows without an id stay."""
    own, id_, key = _unused(docs, "_own_key", "_other_id", "_other_key")
    judged = stored(neardup.near_duplicates(docs, percent=SIMILARITY_PERCENT), "judged")
    same = (F.col("doc_id") == F.col(id_)) & (F.col(own) == F.col(key))
    keyed = docs.withColumn(own, F.xxhash64("text"))
    gone = judged.filter(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    left = keyed.join(gone, same, "left_anti")
    # rows equal in id and text; only they are brought together
    twice = judged.filter("kept").groupBy("doc_id", "text_key").count().filter("count > 1 and doc_id is not null").select(
        F.col("doc_id").alias(id_), F.col("text_key").alias(key))
    once = left.join(twice, same, "left_anti")
    if twice.limit(1).count():
        once = once.unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", own]))
    return once.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that resembles a benchmark item."""
    found = decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stored(found.select("doc_id", F.col("doc_key").alias("_gone_key")).distinct(), "contaminated")
    return _without(docs, gone).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; ``n_chars`` is that of the new text."""
    id_, key, spans = _unused(docs, "_found_id", "_found_key", "_found_spans")
    found = pii.find(docs).filter(F.size("spans") > 0).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("spans").alias(spans))
    found = stored(found.dropDuplicates([id_, key]), "personal")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("doc_id", "text") == F.col(key))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(pii.redacted(F.col("text"), F.col(spans)))
    changed = docs.join(found, same, "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 1024 tokens."""
    import public_tokenizers
    return packing.packed(docs, vocabulary=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("personal_data", redact_personal_data), ("packing", pack)]

# no stage but the fixed forms of personal data can be stated in SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
