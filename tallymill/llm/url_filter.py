"""URL filter: rules for hosts and paths, and a logistic regression for the rest.

DataFrame functions and Spark's own JVM learner only.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the character n-grams, and the number of hashed features.
GRAMS = (3, 4, 5)
FEATURES = 1 << 15
#: Most URLs that rules allow the model is fitted on: those with the smallest hashes.
TRAINING_ROWS = 20_000

#: The small labelled URL table: sites that are unwanted or wanted by their names,
#: each at several places, so that only the name tells them apart.
UNWANTED = (
    "casino-win", "online-casino", "free-bets", "best-bets", "poker-bonus", "cheap-pills", "buy-pills-now",
    "adult-x", "xxx-adult", "spam-farm", "link-farm", "ads-track", "ad-tracker", "replica-watches", "payday-loans",
)
WANTED = (
    "library", "university", "museum", "weather", "science-news", "encyclopedia", "gardening", "recipes",
    "travel-blog", "manual", "city-council", "open-data", "forum", "radio", "history-society",
)
PLACES = (
    "http://{}.example.com/en/1", "https://www.{}.example.net/fr/22.html", "http://blog.{}.example.org/de/333?page=2",
    "https://m.{}.example.com/es/4444/", "http://{}.example/",
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null without one.

    ``rules`` is a short list of (``host/path``, verdict). Of rules of equal
    length the first wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(reversed(rules), key=lambda r: len(r[0])):
        where, _, start = text.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith("/" + start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, kind: str) -> Column:
    text = F.concat(F.lit("^"), text, F.lit("$"))
    n = F.char_length(text)
    return F.concat(
        *[
            F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i, k=k: F.concat(F.lit(kind), F.substring(text, i, F.lit(k)))))
            .otherwise(F.array().cast("array<string>"))
            for k in GRAMS
        ]
    )


def _features(rows: DataFrame) -> DataFrame:
    # numbers and the last label of a host say little, and the rules tell hosts apart by just that label
    name = F.regexp_replace("host", r"\.[^.]*$", "")
    plain = [F.regexp_replace(c, "[0-9]+", "0") for c in (name, F.col("path"))]
    rows = rows.withColumn("_grams", F.concat(_grams(plain[0], "h"), _grams(plain[1], "p")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features").transform(rows)


def _training(judged: DataFrame) -> DataFrame:
    """The labelled table, and distinct URLs that a rule allows.

    What rules allow shows what ordinary URLs look like. What they block says
    nothing about its URL: a rule blocks a whole section of a site. The three
    groups weigh the same.
    """
    spark = judged.sparkSession
    ruled = judged.where("verdict = 'allow'").select("host", "path", F.lit(0.0).alias("label")).distinct()
    ruled = ruled.orderBy(F.xxhash64("host", "path"), "host", "path").limit(TRAINING_ROWS)
    labelled = [(place.format(name), float(label)) for label, names in ((1, UNWANTED), (0, WANTED)) for name in names for place in PLACES]
    url = F.col("url")
    entries = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in labelled])
    known = spark.range(1).select(F.inline(entries)).select(host(url).alias("host"), path(url).alias("path"), "label")
    rows = ruled.withColumn("known", F.lit(False)).union(known.withColumn("known", F.lit(True)))
    counts = rows.groupBy("known", "label").agg(F.count("*").alias("n"))
    return rows.join(counts, ["known", "label"]).withColumn("weight", 1 / F.col("n"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_column: str = "url") -> DataFrame:
    """Add ``host, path, rule, verdict`` to ``pages``; same-named columns are replaced.

    A null URL, or one without ``://``, has an empty host and path; no rule fits
    it and the model judges it like any other. The model learns from the labelled
    table and from at most ``TRAINING_ROWS`` distinct URLs that rules allow.
    Repeated rows are kept. An empty table gives no rows.
    """
    url = F.col(url_column).cast("string")
    rows = pages.withColumn("_host", host(url)).withColumn("_path", path(url))
    rule, verdict = rule_of(rules, F.col("_host"), F.col("_path"))
    rows = rows.withColumn("_rule", rule).withColumn("_verdict", verdict)
    for c in ("host", "path", "rule", "verdict"):
        rows = rows.withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    training = _features(_training(rows.select("host", "path", "verdict")))
    model = LogisticRegression(
        featuresCol="_features", labelCol="label", weightCol="weight", regParam=0.001, maxIter=50, standardization=False,
        predictionCol="_blocked", probabilityCol="_share", rawPredictionCol="_odds",
    ).fit(training)
    judged = model.transform(_features(rows))
    says = F.when(F.col("_blocked") == 1, "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce("verdict", says)).drop("_grams", "_features", "_blocked", "_share", "_odds")
