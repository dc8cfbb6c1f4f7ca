"""Matrix factorisation of ratings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.operators.numbering import dense_ids
from tallymill.session import checkpoint

#: Users and items are numbered with so many different numbers at most.
MAX_IDS = 1 << 31
#: Ratings of a block of users or items on average: a task sorts those of one block
#: in memory, and the factors that these need.
BLOCK_RATINGS = 1 << 21
#: Blocks of users and of items at least, as many as ALS makes by itself.
LEAST_BLOCKS = 10


@dataclass
class Factorisation:
    """Factors of users and items, under the keys the ratings have."""

    model: ALSModel
    users: DataFrame
    items: DataFrame
    report: DataFrame

    def predict(self, pairs: DataFrame) -> DataFrame:
        """``pairs (user, item, ...)`` with a ``prediction``, NULL for a user or item without ratings."""
        # the factors are put under the keys first: there are fewer of them than pairs,
        # which are then shuffled once for each side, not again for its numbers
        users, items = (self.factors(s).withColumnRenamed("features", f"_{s}_factors") for s in ("user", "item"))
        both = pairs.join(users, "user", "left").join(items, "item", "left")
        # in floats and from the first on, as the model does
        products = (F.get("_user_factors", F.lit(i)) * F.get("_item_factors", F.lit(i)) for i in range(self.model.rank))
        return both.select(*pairs.columns, reduce(add, products, F.lit(0.0).cast("float")).alias("prediction"))

    def factors(self, side: str) -> DataFrame:
        """The factors of each ``user`` or ``item``."""
        found = self.model.userFactors if side == "user" else self.model.itemFactors
        keys = self.users if side == "user" else self.items
        return keys.join(found, keys[f"{side}_id"] == found["id"]).select(side, "features")


def factorise(ratings: DataFrame, rank: int = 8, iterations: int = 5, seed: int = 42) -> Factorisation:
    """Train factors on ``user``, ``item``, ``rating`` and report the error on them.

    Keys may be of any type that has an order: they are numbered densely for the
    training and put back afterwards. Ratings without a user, item or rating are
    left out. The ratings are read in every iteration and written once for that;
    they are dealt to more blocks the more there are, so that memory is bounded by
    a block.
    The report has one row: the ratings, users and items, the root mean square
    error, and the standard deviation of the ratings, which is the error of
    always predicting their mean.
    """
    given = checkpoint(ratings.select("user", "item", F.col("rating").cast("float").alias("rating")).dropna())
    users, items = dense_ids(given, "user", "user_id"), dense_ids(given, "item", "item_id")
    sizes = [df.count() for df in (users, items)]
    if max(sizes) > MAX_IDS:
        raise ValueError(f"{sizes[0]} users and {sizes[1]} items; at most {MAX_IDS} of each can be numbered")
    kept = checkpoint(
        given.join(users, "user").join(items, "item").select(
            F.col("user_id").cast("int"), F.col("item_id").cast("int"), "rating"
        )
    )
    # blocks of a fixed number would grow with the ratings, and a task holds a whole one
    blocks = max(LEAST_BLOCKS, -(-kept.count() // BLOCK_RATINGS))
    als = ALS(
        rank=rank,
        maxIter=iterations,
        regParam=0.1,
        userCol="user_id",
        itemCol="item_id",
        ratingCol="rating",
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        checkpointInterval=2,
        seed=seed,
    )
    model = als.fit(kept)
    error = RegressionEvaluator(metricName="rmse", labelCol="rating", predictionCol="prediction")
    report = kept.agg(
        F.count("*").alias("ratings"),
        F.lit(sizes[0]).cast("long").alias("users"),
        F.lit(sizes[1]).cast("long").alias("items"),
        F.lit(error.evaluate(model.transform(kept))).alias("rmse"),
        F.stddev_pop("rating").alias("stddev"),
    )
    return Factorisation(model, users, items, report)
