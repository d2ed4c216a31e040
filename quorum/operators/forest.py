"""A forest of trees over explicit bags: class weights of each bag and out-of-bag scores (M1, M4).

How often a row is in a tree's bag is Poisson(1), read from ``md5(id:seed:tree)``, so
bags don't depend on partitions or retries and SQL can state them. Class weights are
those of the bag, n_bag / (classes in the bag * n_class in the bag), for all trees from
one aggregate. Each tree is a Spark ML forest of one tree without its own bootstrap. A
row's out-of-bag score is the mean P(1) of the trees whose bags don't hold it.

Rows never meet trees in a join: bags and probabilities are columns, and only the class
counts (trees x classes) come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.session import cut_lineage

HASH_HEX = 13  # hex digits of the hash: 52 bits


def bag_cuts() -> list[int]:
    """The 52-bit hash values from which a row is in a bag once, twice, ...: shares of the Poisson(1) distribution."""
    cuts, below = [], 0.0
    for k in range(12):  # 12 times and more has a chance of 1 in 10 ** 9
        below += math.exp(-1) / math.factorial(k)
        cuts.append(int(below * 16 ** HASH_HEX))
    return cuts


def _bag_hash(id_col: str, tree: int, seed: int) -> Column:
    """The hash in hex digits, which compare like the numbers that they stand for."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"{seed}:{tree}")))
    return F.substring(key, 1, HASH_HEX)


def _reaches(id_col: str, tree: int, seed: int, cut: int) -> Column:
    return _bag_hash(id_col, tree, seed) >= F.lit(f"{cut:0{HASH_HEX}x}")


def in_bag(id_col: str, tree: int, seed: int) -> Column:
    """Whether a row is in the bag of ``tree``: one hash, where a filter on ``bag_count`` takes one for each of its cuts."""
    return _reaches(id_col, tree, seed, bag_cuts()[0])


def bag_count(id_col: str, tree: int, seed: int) -> Column:
    """How often a row is in the bag of ``tree``; rows with the same id are in it equally often."""
    return sum((F.when(_reaches(id_col, tree, seed, c), 1).otherwise(0) for c in bag_cuts()), F.lit(0))


def bag_weights(train: DataFrame, n_trees: int, seed: int = 42, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """(tree, label, n_bag, weight): size of each class in each bag, and its class weight there."""
    each = train.groupBy(label_col).agg(*[F.sum(bag_count(id_col, t, seed)).alias(str(t)) for t in range(n_trees)])
    long = each.unpivot([label_col], [str(t) for t in range(n_trees)], "tree", "n_bag").filter("n_bag > 0") \
        .withColumn("tree", F.col("tree").cast("int"))
    totals = long.groupBy("tree").agg(F.sum("n_bag").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return long.join(totals, "tree").select("tree", label_col, "n_bag", (F.col("_n") / (F.col("_k") * F.col("n_bag"))).alias("weight"))


@dataclass
class BaggedForest:
    """Trees and the bags that they were fitted on; None stands for the tree of an empty bag, which has no vote."""

    trees: list
    features: list[str]
    seed: int
    id_col: str = "id"

    def _votes(self, df: DataFrame) -> tuple[DataFrame, dict[int, Column]]:
        """``df`` with a column of each tree's probabilities, and P(1) of each tree."""
        out = VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="keep").transform(df)
        votes = {}
        for t, tree in enumerate(self.trees):
            if tree is not None:
                tree.setFeaturesCol("_features").setProbabilityCol(f"_p{t}").setRawPredictionCol("").setPredictionCol("")
                out = tree.transform(out)
                # a bag of good rows only has one class
                votes[t] = F.coalesce(F.get(vector_to_array(f"_p{t}"), F.lit(1)), F.lit(0.0))
        return out, votes

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with score, the mean P(1) of all trees, and the 0/1 prediction."""
        out, votes = self._votes(df)
        mean = sum(votes.values(), F.lit(0.0)) / len(votes)
        out = out.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("score", "prediction")], mean.alias("score"))
        return out.withColumn("prediction", (F.col("score") >= 0.5).cast("double"))

    def out_of_bag(self, train: DataFrame, label_col: str = "label") -> DataFrame:
        """(id, label, n_out, oob_score): the trees whose bags don't hold the row, and their mean P(1); null without any."""
        out, votes = self._votes(train)
        is_out = {t: ~in_bag(self.id_col, t, self.seed) for t in votes}
        total = sum((F.when(is_out[t], p).otherwise(0.0) for t, p in votes.items()), F.lit(0.0))
        n_out = sum((is_out[t].cast("long") for t in votes), F.lit(0).cast("long"))
        return out.select(self.id_col, label_col, n_out.alias("n_out"), total.alias("_total")) \
            .select(self.id_col, label_col, "n_out", F.when(F.col("n_out") > 0, F.col("_total") / F.col("n_out")).alias("oob_score"))

    @property
    def featureImportances(self) -> np.ndarray:
        """Mean of the trees' importances, as shares of their sum."""
        total = sum(t.featureImportances.toArray() for t in self.trees if t is not None)
        return total / total.sum() if total.sum() > 0 else total

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        for t, tree in enumerate(self.trees):
            if tree is not None:
                tree.write().overwrite().save(f"{path}/tree-{t}")
        there = [t for t, tree in enumerate(self.trees) if tree is not None]
        spark.createDataFrame([(len(self.trees), there, self.features, self.seed, self.id_col)],
                              "n_trees int, there array<int>, features array<string>, seed long, id_col string") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BaggedForest:
        r = spark.read.parquet(f"{path}/forest").first()
        there = set(r["there"])
        trees = [RandomForestClassificationModel.load(f"{path}/tree-{t}") if t in there else None for t in range(r["n_trees"])]
        return cls(trees, list(r["features"]), r["seed"], r["id_col"])


def oob_accuracy(scored: DataFrame, label_col: str = "label") -> float | None:
    """Share of the rows with an out-of-bag score whose class it hits at 0.5; None without such rows."""
    hit = (F.col("oob_score") >= 0.5).cast("int") == F.col(label_col)
    return scored.filter(F.col("oob_score").isNotNull()).agg(F.avg(hit.cast("double"))).first()[0]


def fit_bagged(train: DataFrame, features: Sequence[str], tree: RandomForestClassifier, n_trees: int, seed: int = 42,
               balanced: bool = True, weight_col: str | None = None, id_col: str = "id", label_col: str = "label",
               parallelism: int = 4) -> BaggedForest:
    """A tree for each of ``n_trees`` bags, with the settings of ``tree``.

    ``balanced`` weighs the classes of each bag by their sizes in it; ``weight_col``
    is a weight that the rows have anyway. The training rows are written once and
    read by every tree; ``parallelism`` trees are fitted at a time. Rows with a null
    label are left out. Raises ValueError if no bag holds a row.
    """
    names = dict.fromkeys([id_col, label_col, *features, *([weight_col] if weight_col else [])])
    data = cut_lineage(train.filter(F.col(label_col).isNotNull()).select(*names))
    weights: dict[int, dict] = {}
    for r in bag_weights(data, n_trees, seed, id_col, label_col).collect():  # one row a tree and class
        weights.setdefault(r["tree"], {})[r[label_col]] = r["weight"] if balanced else 1.0
    if not weights:
        raise ValueError("there are no rows to fit a forest on")
    rows = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep").transform(data)

    def one(t: int):
        if t not in weights:
            return None
        by_class = F.coalesce(*[F.when(F.col(label_col) == k, F.lit(float(w))) for k, w in weights[t].items()], F.lit(0.0))
        bag = rows.filter(in_bag(id_col, t, seed)) \
            .withColumn("_w", bag_count(id_col, t, seed) * by_class * (F.col(weight_col) if weight_col else F.lit(1.0)))
        est = tree.copy().setNumTrees(1).setBootstrap(False).setSubsamplingRate(1.0).setSeed(seed + t) \
            .setFeaturesCol("_features").setLabelCol(label_col).setWeightCol("_w")
        return est.fit(bag)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return BaggedForest(list(pool.map(one, range(n_trees))), list(features), seed, id_col)
