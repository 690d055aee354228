"""Training sets and their measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.operators.roles import alike, fitted_on_alike, weighed


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with an equal key the last."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def label_stats(rows: DataFrame, label: str) -> DataFrame:
    """Count and share of each label."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("total")).alias("share"))


def length_bins(rows: DataFrame, length: Column, width: int) -> DataFrame:
    return rows.groupBy((F.floor(length / width) * width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def confusion(rows: DataFrame) -> DataFrame:
    """rows(truth, pred) -> counts of each pair."""
    return rows.groupBy("truth", "pred").agg(F.count("*").alias("n"))


def scores_by_class(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where undefined."""
    c = confusion(rows)
    t = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    p = c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    out = t.join(p, "label", "full_outer").na.fill(0, ["support", "hit", "predicted"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumn("precision", ratio(F.col("hit"), F.col("predicted"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def worst_confusions(rows: DataFrame, top: int = 10, examples: int = 5) -> DataFrame:
    """The commonest wrong pairs with their first examples by id."""
    wrong = rows.where("truth <> pred")
    few = wrong.withColumn("_r", F.row_number().over(W.partitionBy("truth", "pred").orderBy("id"))).where(F.col("_r") <= examples)
    shown = few.groupBy("truth", "pred").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("examples"))
    return confusion(wrong).join(shown, ["truth", "pred"]).orderBy(F.desc("n"), "truth", "pred").limit(top)


def split(rows: DataFrame, label: str, key: str, test: float = 0.2) -> DataFrame:
    """A stratified split: per class the first share by hash of the key is the test set."""
    w = W.partitionBy(label)
    rank = F.row_number().over(w.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key))
    return rows.withColumn("part", F.when(rank <= F.floor(F.count("*").over(w) * test), "test").otherwise("train"))


def entity_scores(truth: DataFrame, pred: DataFrame, on: list[str]) -> DataFrame:
    """Exact spans found: true and false positives, misses, precision, recall and F1 by label."""
    both = truth.withColumn("t", F.lit(1)).join(pred.withColumn("p", F.lit(1)), on, "full_outer")
    n = both.groupBy("label").agg(F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_metrics(rows: DataFrame) -> DataFrame:
    """rows(truth, pred, confidence) -> for each true label and for all (null): n, right, accuracy, mean confidence, and how many are in each band of confidence."""
    c = F.col("confidence")
    among = lambda test: F.count(F.when(test, 1))
    judged = rows.select("truth", (F.col("truth") == F.col("pred")).alias("hit"), "confidence")
    out = judged.rollup("truth").agg(F.count("*").alias("n"), among(F.col("hit")).alias("right"), F.avg("confidence").alias("mean_confidence"), among(c > 0.9).alias("over_90"), among((c > 0.7) & (c <= 0.9)).alias("to_90"), among((c > 0.5) & (c <= 0.7)).alias("to_70"), among(c <= 0.5).alias("to_50"))
    return out.withColumn("accuracy", F.col("right") / F.col("n"))


def set_checks(rows: DataFrame, rare: int = 5, least_rows: int = 20, ratio: int = 10) -> DataFrame:
    """rows(label) -> one row: labels, the largest and the least count, if they are out of balance, labels with few examples, if result rows are too few."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    some = counts.agg(F.count("*").alias("labels"), F.max("n").alias("most"), F.min("n").alias("fewest"), F.count(F.when(F.col("n") < rare, 1)).alias("rare"), F.coalesce(F.max(F.when(F.col("label") == "TEST_ROW", F.col("n"))), F.lit(0)).alias("test_rows"))
    return some.withColumns({"unbalanced": F.col("most") > ratio * F.col("fewest"), "few_test_rows": F.col("test_rows") < least_rows})


def role_documents(rows: DataFrame) -> DataFrame:
    """rows(doc_id, role, role_confidence) -> doc_id, lines, mean confidence and the number of lines of each role, as a map in JSON by role."""
    each = rows.groupBy("doc_id", "role").agg(F.count("*").alias("n"), F.sum("role_confidence").alias("c"))
    roles = F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n"))))
    return each.groupBy("doc_id").agg(F.sum("n").alias("lines"), F.round(F.sum("c") / F.sum("n") + 1e-9, 6).alias("confidence"), F.to_json(roles).alias("roles"))


def tag_stats(tokens: DataFrame, mostly: float = 0.8, seldom: float = 0.3) -> DataFrame:
    """tokens(id, tag) -> entities (B), tokens (B and I) and examples of each type; and for O its share of all tokens and the band it is in."""
    kind = F.when(F.col("tag") == "O", "O").otherwise(F.substring_index("tag", "-", -1))
    each = tokens.groupBy(kind.alias("type")).agg(F.count(F.when(F.col("tag").startswith("B-"), 1)).alias("entities"), F.count("*").alias("tokens"), F.countDistinct("id").alias("examples"))
    total = each.agg(F.sum("tokens").alias("total"))
    share = F.when(F.col("type") == "O", F.col("tokens") / F.col("total"))
    band = F.when(share > mostly, "mostly outside").when(share < seldom, "seldom outside").when(share.isNotNull(), "balanced")
    return each.crossJoin(F.broadcast(total)).select("type", "entities", "tokens", "examples", F.round(share, 6).alias("share"), band.alias("band"))  # one row of totals


def fit_role_classifier(rows: DataFrame, features: int = 1 << 14):
    """Word and bigram TF-IDF with three numbers, and a balanced logistic regression; rows(text, y, bold, tertile, label).

    Terms are counted over all rows; the regression reads like rows once, with their weights added up.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, StringIndexer, VectorAssembler

    every = weighed(rows)
    steps = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern="[^a-z0-9%]+"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        HashingTF(inputCol="words", outputCol="tf1", numFeatures=features),
        HashingTF(inputCol="pairs", outputCol="tf2", numFeatures=features),
        IDF(inputCol="tf1", outputCol="idf1"),
        IDF(inputCol="tf2", outputCol="idf2"),
        VectorAssembler(inputCols=["idf1", "idf2", "y", "bold", "tertile"], outputCol="features"),
        StringIndexer(inputCol="label", outputCol="index", handleInvalid="keep"),
        LogisticRegression(featuresCol="features", labelCol="index", weightCol="weight", maxIter=20, regParam=0.01),
    ]
    before, made = fitted_on_alike(steps, every, alike(every))
    return PipelineModel([*before.stages, steps[-1].fit(made)])


def role_features(rows: DataFrame) -> DataFrame:
    """Adds the numbers that the classifier reads beside the text: y, bold, third of the page."""
    y = F.col("y") / 1000.0
    return rows.withColumns({"y": y, "bold": F.col("is_bold").cast("double"), "tertile": F.when(y <= 0.33, 0.0).when(y <= 0.67, 1.0).otherwise(2.0)})
