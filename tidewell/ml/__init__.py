"""Models: unregularised logistic risk, TF-IDF text classification, metrics in DataFrames."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, IDF, NGram, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fit_risk(train: DataFrame, features: list[str], label: str):
    """Logistic regression without regularisation, on given columns."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol=label, regParam=0.0, standardization=False, maxIter=100)]).fit(train)


def score(model, df: DataFrame) -> DataFrame:
    """``df`` with ``score``, the probability of the positive class."""
    out = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return out.drop("__x", "rawPrediction", "probability", "prediction")


def fit_text(train: DataFrame, text: str, label: str, weight: str | None = None):
    """TF-IDF over words and word pairs, then (optionally weighted) logistic regression."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__w", pattern="[a-z]{2,}", gaps=False), NGram(n=2, inputCol="__w", outputCol="__b"),
        SQLTransformer(statement="SELECT *, concat(__w, __b) AS __t FROM __THIS__"), CountVectorizer(inputCol="__t", outputCol="__c", vocabSize=1 << 16, minDF=2.0), IDF(inputCol="__c", outputCol="__f"),
        LogisticRegression(featuresCol="__f", labelCol=label, regParam=0.01, maxIter=50, **({"weightCol": weight} if weight else {})),
    ]
    return Pipeline(stages=stages).fit(train)


def balance(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` so that every class weighs alike."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    return df.join(F.broadcast(counts.crossJoin(total)), label).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def metrics(scored: DataFrame, label: str) -> DataFrame:
    """n, base rate, mean score, Brier score, log loss."""
    y, p = F.col(label).cast("double"), F.least(F.greatest(F.col("score"), F.lit(1e-12)), F.lit(1 - 1e-12))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("base_rate"), F.avg("score").alias("mean_score"), F.avg((F.col("score") - y) ** 2).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def areas(scored: DataFrame, label: str) -> DataFrame:
    """ROC and PR area (average precision) from counts by score: no pairs are made, and the running
    counts go through range partitions, not one task."""
    by = scored.groupBy("score").agg(F.sum(label).cast("long").alias("p"), F.count(F.lit(1)).alias("n"))
    run = running_sums(by, F.desc("score"), ["p", "n"])  # with the row's own
    total = by.agg(F.sum("p").alias("all_p"), F.sum(F.col("n") - F.col("p")).alias("all_q"))
    t = run.crossJoin(F.broadcast(total))
    below = F.col("all_q") - (F.col("n_upto") - F.col("p_upto"))
    roc = F.sum(F.col("p") * below + F.col("p") * (F.col("n") - F.col("p")) / 2.0) / (F.max("all_p").cast("double") * F.max("all_q"))
    pr = F.sum(F.col("p") / F.col("all_p") * F.col("p_upto") / F.col("n_upto"))
    return t.agg(roc.alias("roc_auc"), pr.alias("pr_auc"))


def running_sums(df: DataFrame, order: Column, columns: list[str]) -> DataFrame:
    """``df`` with ``<column>_upto``, the sum of each column up to the row in ``order`` (unique)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()).persist()
    sums = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__before_{c}") for c in columns])  # one row a part
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__part", *[F.coalesce(F.sum(f"__before_{c}").over(earlier), F.lit(0)).alias(f"__before_{c}") for c in columns])
    here = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(before), "__part")
    return out.withColumns({f"{c}_upto": F.sum(c).over(here) + F.col(f"__before_{c}") for c in columns}).drop("__part", *[f"__before_{c}" for c in columns])


def macro(long: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    """Accuracy and macro precision, recall and F1 of each group, from its confusion counts."""
    cells = long.groupBy(*by, F.col(actual).alias("__y"), F.col(predicted).alias("__h")).agg(F.count(F.lit(1)).alias("__n"))
    classes = cells.select(*by, "__n", F.explode(F.array_distinct(F.array("__y", "__h"))).alias("class"), "__y", "__h")
    count = lambda ok: F.sum(F.when(ok, F.col("__n")).otherwise(0))
    y, h = F.col("__y") == F.col("class"), F.col("__h") == F.col("class")
    per = classes.groupBy(*by, "class").agg(count(y).alias("support"), count(h).alias("predicted"), count(y & h).alias("tp"))
    part = lambda a, b: F.round(F.avg(F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)))), 4)
    tp, s, p = F.col("tp"), F.col("support"), F.col("predicted")
    return per.groupBy(*by).agg(F.sum("support").alias("n"), F.sum("tp").alias("correct"), F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"), part(tp, p).alias("macro_precision"), part(tp, s).alias("macro_recall"), part(2 * tp, p + s).alias("macro_f1"))


def agreement(rows: DataFrame, actual: str, a: str, b: str) -> DataFrame:
    """How often two predictors agree, and who is right then."""
    right = lambda c: F.count_if(F.col(c) == F.col(actual))
    by = rows.groupBy(F.when(F.col(a) == F.col(b), "agree").otherwise("disagree").alias("verdict")).agg(F.count(F.lit(1)).alias("n"), right(a).alias("a_right"), right(b).alias("b_right"))
    total = by.agg(F.sum("n").alias("__all"))
    return by.crossJoin(F.broadcast(total)).select("verdict", "n", F.round(F.lit(100.0) * F.col("n") / F.col("__all"), 1).alias("pct"), "a_right", "b_right")


def seen_unseen(trained: DataFrame, held: DataFrame, template: list[str], actual: str, predicted: str) -> DataFrame:
    """Accuracy on held-out rows by whether training had their template."""
    known = trained.select(*[F.col(c).alias(f"__{c}") for c in template]).distinct().withColumn("__seen", F.lit(True))
    on = [F.col(c) == F.col(f"__{c}") for c in template]
    h = held.join(known, on, "left").withColumn("seen", F.coalesce("__seen", F.lit(False)))
    n, right = F.count(F.lit(1)), F.count_if(F.col(predicted) == F.col(actual))
    return h.groupBy("seen").agg(n.alias("n"), right.alias("correct"), F.round(F.lit(100.0) * right / n, 2).alias("accuracy_pct"))


def verdict(weight: str, fitted: str) -> Column:
    """What to say of a fitted coefficient beside the weight that made the data."""
    w, f = F.col(weight), F.col(fitted)
    return F.when((w == 0) & (F.abs(f) < 0.10), "placebo, near zero").when(w == 0, "PLACEBO PICKED UP WEIGHT").when(F.signum(f) != F.signum(w), "WRONG SIGN").when((f / w).between(0.3, 1.3), "recovered, attenuated").otherwise("off")


def trend(series: DataFrame, day: str, value: str, deviations: float) -> DataFrame:
    """A straight line through a daily series (``fit``), and whether a day lies further off it than so
    many standard deviations of the residuals."""
    first = series.agg(F.min(day).alias("__d0"))
    x = series.crossJoin(F.broadcast(first)).withColumn("__t", F.datediff(day, "__d0")).drop("__d0")
    line = x.agg(F.regr_slope(value, "__t").alias("__b"), F.regr_intercept(value, "__t").alias("__a"))
    r = x.crossJoin(F.broadcast(line)).withColumn("fit", F.col("__a") + F.col("__b") * F.col("__t")).withColumn("__r", F.col(value) - F.col("fit"))
    spread = r.agg(F.stddev_samp("__r").alias("__s"))
    return r.crossJoin(F.broadcast(spread)).withColumn("is_anomaly", F.abs("__r") > deviations * F.col("__s")).drop("__t", "__a", "__b", "__r", "__s")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed: int = 1) -> DataFrame:
    """Adds ``fold`` (0 to folds - 1): each class is dealt evenly, in a seeded order of its keys."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % folds).cast("int"))


def sublinear(counts: Column) -> Column:
    """1 + ln(count) of each count, 0 of none."""
    return F.transform(counts, lambda c: F.when(c > 0, 1 + F.log(c)).otherwise(0.0))


def cross_validate(df: DataFrame, text: str, label: str, key: str, folds: int = 2) -> DataFrame:
    """Macro scores by fold of the text model, each fold scored by a fit on the others."""
    dealt = stratified_folds(df, label, key, folds).persist()
    out = None
    for k in range(folds):
        train = balance(dealt.where(F.col("fold") != k), label)
        s = score(fit_text(train, text, label, "weight"), dealt.where(F.col("fold") == k)).select("fold", label, (F.col("score") >= 0.5).cast(df.schema[label].dataType).alias("predicted"))
        out = s if out is None else out.unionByName(s)
    return macro(out, ["fold"], label, "predicted")


def coefficients(model, features: list[str]) -> list[tuple[str, float]]:
    """The fitted weight of each feature, in order."""
    return list(zip(features, map(float, model.stages[-1].coefficients), strict=True))


def sql_score(model, features: list[str]) -> str:
    """The model as a SQL expression over its features, to be called from any query."""
    terms = [f"{w!r} * {n}" for n, w in coefficients(model, features)]
    return f"1 / (1 + exp(-({' + '.join([repr(float(model.stages[-1].intercept)), *terms])})))"


class Registry:
    """Fitted models on disk, by name and version, with their metrics in a long table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/models/{name}")
        return sorted(int(x.getPath().getName()[1:]) for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def save(self, name: str, model, metrics: dict[str, dict[str, float]]) -> int:
        """Saves the next version and its metrics by split; the latest is the default."""
        version = max(self.versions(name), default=0) + 1
        model.save(f"{self.path}/models/{name}/v{version}")
        rows = [(name, version, split, m, float(v)) for split, values in metrics.items() for m, v in values.items()]
        self.spark.createDataFrame(rows, "model_name string, model_version int, split string, metric string, value double").write.mode("append").parquet(f"{self.path}/metrics")
        return version

    def load(self, name: str, version: int | None = None):
        from pyspark.ml import PipelineModel

        return PipelineModel.load(f"{self.path}/models/{name}/v{version or self.versions(name)[-1]}")

    def metrics(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/metrics")
