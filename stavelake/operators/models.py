"""Group classifier on percentile vectors: standardized multinomial logistic regression with balanced weights."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.operators import calibrate, ranks

FOLDS = 5
TOP = 3
STEER_GAP = 10


def wide(profile: DataFrame, axes: tuple[str, ...], keep: tuple[str, ...] = ("piece_id", "genre")) -> DataFrame:
    """One row per piece, one percentile column per axis."""
    return profile.groupBy(*keep).pivot("axis", list(axes)).agg(F.first("percentile").cast("double"))


MAX_ITERATIONS = 3000


#: Rows of a task at least. A fit takes up to thousands of passes over the rows, so tasks of a few rows would cost more than the rows.
FIT_ROWS = 1 << 12


def fit_parts(rows: int, own: int, cores: int) -> int:
    """Over how many of its ``own`` partitions a fit reads its rows: as many as the rows ask for, no more than twice the cores."""
    return max(1, min(own, 2 * cores, -(-rows // FIT_ROWS)))


class GenreModel:
    """A fitted classifier with its class order."""

    def __init__(self, model: PipelineModel, classes: list, axes: tuple[str, ...]):
        self.model, self.classes, self.axes = model, classes, axes

    @classmethod
    def fit(cls, features: DataFrame, axes: tuple[str, ...], standardize: bool = True, penalty: float = 1.0) -> "GenreModel":
        """``penalty`` is the inverse strength on the summed loss, so the averaged loss gets 1/(penalty*n).

        A fit that has not converged after MAX_ITERATIONS is refused.
        """
        sizes = features.groupBy("genre").agg(F.count(F.lit(1)).alias("n_g"))
        # Group labels are few; this is the class list, not data.
        rows = sorted(sizes.collect(), key=lambda r: r["genre"])
        classes, n = [r["genre"] for r in rows], sum(r["n_g"] for r in rows)
        weight = F.create_map(*[F.lit(x) for r in rows for x in (r["genre"], n / (len(rows) * r["n_g"]))])
        label = F.create_map(*[F.lit(x) for i, g in enumerate(classes) for x in (g, float(i))])
        data = features.withColumns({"label": F.element_at(label, F.col("genre")), "weight": F.element_at(weight, F.col("genre"))})
        data = data.coalesce(fit_parts(n, data.rdd.getNumPartitions(), data.sparkSession.sparkContext.defaultParallelism))
        stages = [VectorAssembler(inputCols=list(axes), outputCol="raw")]
        if standardize:
            stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
        else:
            stages[0].setOutputCol("features")
        stages.append(LogisticRegression(
            family="multinomial", weightCol="weight", regParam=1.0 / (penalty * n), elasticNetParam=0.0, standardization=False, maxIter=MAX_ITERATIONS,
        ))
        model = Pipeline(stages=stages).fit(data)
        if model.stages[-1].summary.totalIterations >= MAX_ITERATIONS:
            raise RuntimeError(f"the classifier has not converged after {MAX_ITERATIONS} iterations")
        return cls(model, classes, axes)

    def score(self, features: DataFrame) -> DataFrame:
        """Adds ``p``, the class probabilities in class order."""
        df = self.model.transform(features)
        return df.select(*features.columns, vector_to_array("probability").alias("p"))

    def _ranked(self) -> Column:
        names = F.array(*map(F.lit, self.classes))
        pairs = F.arrays_zip(F.col("p").alias("p"), names.alias("g"))
        return F.reverse(F.sort_array(F.transform(pairs, lambda x: F.struct(x["p"].alias("p"), x["g"].alias("g")))))

    def read(self, features: DataFrame) -> DataFrame:
        """Top classes and the rank of the piece's own genre (1 = most probable)."""
        df = self.score(features).withColumn("ranked", self._ranked())
        order = F.transform("ranked", lambda x: x["g"])
        place = F.array_position(order, F.col("genre"))
        return df.select(
            "piece_id", "genre", F.element_at("ranked", 1)["g"].alias("reads_as"), F.round(F.element_at("ranked", 1)["p"], 2).alias("p_top"),
            F.slice(order, 1, TOP).alias("top"), F.when(place > 0, place).otherwise(99).cast("int").alias("rank"),
        )

    def coefficients(self) -> DataFrame:
        """(genre, axis, coef), classes x axes rows."""
        from pyspark.sql import SparkSession

        matrix = self.model.stages[-1].coefficientMatrix.toArray()
        rows = [(g, a, float(matrix[i][j])) for i, g in enumerate(self.classes) for j, a in enumerate(self.axes)]
        return SparkSession.active().createDataFrame(rows, "genre int, axis string, coef double" if isinstance(self.classes[0], int) else "genre string, axis string, coef double")


def cross_validated_ranks(features: DataFrame, axes: tuple[str, ...], folds: int = FOLDS) -> DataFrame:
    """Own-genre rank of every piece under a model that never saw it; folds come from a hash of the id."""
    marked = features.withColumn("_fold", F.pmod(F.xxhash64("piece_id"), F.lit(folds)).cast("int"))
    parts = []
    for k in range(folds):
        model = GenreModel.fit(marked.filter(F.col("_fold") != k).drop("_fold"), axes)
        parts.append(model.read(marked.filter(F.col("_fold") == k).drop("_fold")))
    return reduce(DataFrame.unionByName, parts)


def rank_thresholds(cv_ranks: DataFrame) -> DataFrame:
    """Per genre the admitted quantile and the median of cross-validated ranks (ranks are at most the class count)."""
    return cv_ranks.groupBy("genre").agg(
        F.ceil(F.round(calibrate.small_quantile(F.col("rank"), calibrate.ADMIT), 9)).cast("int").alias("clf_rank_threshold"),
        F.percentile("rank", F.lit(0.5)).cast("int").alias("clf_rank_median"),
    )


def steer(profile: DataFrame, reads: DataFrame, coefficients: DataFrame, k: int = 5) -> DataFrame:
    """For pieces that read as another genre: the k axes whose move toward the genre's median matters most.

    Axes are ranked by gap times coefficient; those within ten percentiles are not listed.
    """
    cum = ranks.cumulative(profile.withColumn("percentile", F.col("percentile").cast("double")), ["genre", "axis"], "percentile")
    median = ranks.quantiles(cum, ["genre", "axis"], "percentile", {"center": 0.5}).drop("n")
    gap = F.col("center") - F.col("percentile")
    off = reads.filter(F.col("reads_as") != F.col("genre")).select("piece_id")
    df = profile.join(off, "piece_id", "left_semi").join(median, ["genre", "axis"]).join(coefficients, ["genre", "axis"])
    from pyspark.sql import Window as W

    w = W.partitionBy("piece_id").orderBy(F.desc("pull"), "axis")
    return (
        df.select("piece_id", "genre", "axis", gap.alias("gap"), (F.abs(gap) * F.abs("coef")).alias("pull"))
        .withColumn("rank", F.row_number().over(w))
        .filter((F.col("rank") <= k) & (F.abs("gap") >= STEER_GAP))
        .select("piece_id", "genre", "axis", F.when(F.col("gap") > 0, "raise").otherwise("lower").alias("move"), "gap", "rank")
    )
