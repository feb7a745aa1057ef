"""A sparse rule ensemble for text quality.

Shallow random trees over text statistics propose rules (each path from a root to any node is one conjunction of
comparisons); a logistic model with a lasso penalty gives most of them weight zero. What is left is compiled into one Spark
column expression: a weighted sum of rules behind a sigmoid. Scoring a corpus is a projection, without a shuffle.

The model is fitted on at most ``SAMPLE`` labelled rows, taken in the order of a hash of their ids; labels, ids and other
columns are never inputs of a score. Null and empty texts have a score like any other (all their statistics are zero).
Labels that are null, or whose row has no document, are left out; if only one class is left the score is that share, and
``UNLABELLED`` if there are none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.llm.common import stored

SAMPLE = 20_000
TREES, TREE_DEPTH, MIN_LEAF = 12, 4, 10
LASSO = 0.002
THRESHOLD = 0.7
UNLABELLED = 0.95  # the score of every text where nothing is labelled: nothing is known against any
# fixed values: the characters that each share counts
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÑÓÔÖÚÛÜ"
_SYMBOLS = "#$%&*+<=>@[]\\^_`{}~|"
_SHARES = {"upper": _UPPER, "symbol": _SYMBOLS, "digit": "0123456789"}
_SINGLE = {"bang": "!", "bar": "|", "stop": ".", "comma": ",", "line": "\n"}
STATISTICS = ["length", "mean_word", "distinct_words", *_SHARES, *_SINGLE]

Condition = tuple[str, bool, float]  # a statistic, whether it must be over the bound, and the bound


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the statistics of each text, each computed once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = F.length(text)
    counted = {name: n - F.length(F.translate(text, chars, "")) for name, chars in _SHARES.items()}
    counted |= {name: n - F.length(F.replace(text, F.lit(char), F.lit(""))) for name, char in _SINGLE.items()}
    words = F.split(text, " ")
    raw = F.struct(n.alias("n"), F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("different"),
                   *[c.alias(name) for name, c in counted.items()])
    df = docs.select(*keep, F.inline(F.array(raw)))
    some = F.greatest(F.col("n"), F.lit(1)).cast("double")
    return df.select(*keep, F.log1p(F.col("n").cast("double")).alias("length"),
                     (F.col("n") / F.col("words")).alias("mean_word"),
                     F.when(F.col("n") == 0, 0.0).otherwise(F.col("different") / F.col("words")).alias("distinct_words"),
                     *[(F.col(name) / some).alias(name) for name in counted])


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]  # each a conjunction and its weight

    def score(self) -> Column:
        """The model as a column over the statistics."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(_conjunction(conditions), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _conjunction(conditions: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for name, over, bound in conditions:
        out = out & (F.col(name) > bound if over else F.col(name) <= bound)
    return out


def tree_rules(node, path: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """The conjunctions that lead to the nodes of a fitted tree, each statistic bounded once per side."""
    found = [_tight(path)] if path else []
    if node.subtreeDepth() == 0:
        return found
    split = node.split()
    name, bound = STATISTICS[split.featureIndex()], float(split.threshold())
    return found + tree_rules(node.leftChild(), path + ((name, False, bound),)) + tree_rules(node.rightChild(), path + ((name, True, bound),))


def _tight(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    bounds: dict[tuple[str, bool], float] = {}
    for name, over, bound in path:
        old = bounds.get((name, over))
        bounds[name, over] = bound if old is None else (max if over else min)(old, bound)
    return tuple(sorted((name, over, bound) for (name, over), bound in bounds.items()))


def fit(labelled: DataFrame, *, label_col: str = "label", text_col: str = "text",
        lasso: float = LASSO) -> RuleModel:
    """A model of ``label`` (0 or 1) from ``id, text, label`` rows."""
    rows = stored(statistics(labelled, [F.col(label_col).cast("double").alias("label")], text_col), "statistics").coalesce(4)
    shares = rows.agg(F.count("*"), F.sum("label")).first()
    count, ones = shares[0], shares[1] or 0.0
    if ones in (0, count):
        share = (ones + 0.5) / (count + 1) if count else UNLABELLED
        return RuleModel(_logit(share), ())
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, minInstancesPerNode=MIN_LEAF, subsamplingRate=0.7,
                                    featureSubsetStrategy="onethird", seed=7).fit(vectors)
    rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree._call_java("rootNode"))})
    if not rules:
        return RuleModel(_logit(ones / count), ())
    held = rows.select("label", F.array(*[_conjunction(r).cast("double") for r in rules]).alias("held"))
    from pyspark.ml.functions import array_to_vector
    binary = held.select("label", array_to_vector("held").alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(binary)
    weights = model.coefficients.toArray()
    return RuleModel(float(model.intercept), tuple((rule, float(w)) for rule, w in zip(rules, weights) if w))


def _logit(share: float) -> float:
    import math
    return math.log(share / (1 - share))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, label_col: str, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``sample`` labelled documents, by a hash of the id: the same ones however the tables are split."""
    chosen = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"))
              .orderBy(F.xxhash64("_id"), "_id", "label").limit(sample))
    # ``sample`` rows of two numbers
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col)).join(F.broadcast(chosen), "_id")


def scored(docs: DataFrame, model: RuleModel, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``keep`` and the score of every row. The columns to keep may be named like statistics."""
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).alias("_text"))
    return statistics(rows, ["_row"], "_text").select("_row.*", model.score().alias(score_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, **options) -> RuleModel:
    """The quality model of ``labels.quality``, learnt from the rows that are not held out."""
    chosen = labelled_sample(docs, labels.filter(~held_out()), label_col="quality")
    return fit(chosen, **options)
