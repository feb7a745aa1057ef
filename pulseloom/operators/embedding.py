"""Text embedding and the vector table."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from pulseloom.functions import text as tx
from pulseloom.functions.language import tokens
from pulseloom.operators.ranking import top_n


def embed(df: DataFrame, text: str, out: str = "vec", embedder=None, dims: int = 256, idf: bool = False) -> DataFrame:
    """Add a vector per text.

    ``embedder`` is a vectorised UDF text -> array<double>; a text it fails on (null) gets the zero vector. Without one,
    hashed token frequencies of unit length are used; ``idf`` weighs tokens by rarity, at the cost of one more pass.
    """
    zero = F.array_repeat(F.lit(0.0), dims)
    if embedder is not None:
        return df.withColumn(out, F.coalesce(embedder(F.col(text)), zero))
    listed = df.withColumn("_tokens", F.filter(tokens(F.coalesce(F.col(text), F.lit(""))), lambda t: t != ""))
    features = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims).transform(listed)
    weighted = "_tf"
    if idf:
        features = IDF(inputCol="_tf", outputCol="_weighted").fit(features).transform(features)
        weighted = "_weighted"
    scaled = Normalizer(inputCol=weighted, outputCol="_unit").transform(features)
    # a zero vector has no direction: it stays zero instead of turning into NaN
    some = F.size("_tokens") > 0
    return scaled.withColumn(out, F.when(some, vector_to_array("_unit")).otherwise(zero)).drop("_tokens", "_tf", "_weighted", "_unit")


def stored_or_embedded(queries: DataFrame, store: DataFrame, text: str, embedder=None, dims: int = 256) -> DataFrame:
    """Vectors of query texts, taken from the store where it has them. Only the rest is embedded."""
    named = queries.withColumn("id", tx.topic_id(F.col(text)))
    known = named.join(store.select("id", F.col("vector").alias("vec")), "id")
    missing = named.join(store.select("id"), "id", "left_anti")
    return known.unionByName(embed(missing, text, "vec", embedder, dims))


def topics_to_index(batch: DataFrame, store: DataFrame, text: str = "text", order: str = "ord") -> DataFrame:
    """Non-blank texts of a batch that the store does not have, each once: only these are worth embedding."""
    named = batch.filter(F.trim(F.col(text)) != "").withColumn("id", tx.topic_id(F.col(text)))
    first = top_n(named, 1, ["id"], [order], "_rank").drop("_rank")
    return first.join(store.select("id"), "id", "left_anti")
