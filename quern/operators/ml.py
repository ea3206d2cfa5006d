"""Machine learning over the tables, by pyspark.ml; each entry fits on whole tables and gives small results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml import classification as cl
from pyspark.ml import clustering as cu
from pyspark.ml import evaluation as ev
from pyspark.ml import feature as fe
from pyspark.ml import fpm
from pyspark.ml import recommendation as rec
from pyspark.ml import regression as rg
from pyspark.ml import stat, tuning
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def points(t: Tables) -> DataFrame:
    """label (0 or 1), number, and the vector `features` of every line."""
    df = t("lineitem").select(*NUMBERS, (F.col("l_returnflag") == "R").cast("double").alias("label"), F.col("l_extendedprice").alias("number"))
    return fe.VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(df)


def texts(t: Tables) -> DataFrame:
    return fe.RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+").transform(t("benchmark"))


def counted(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def as_text(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.select(*keys, vector_to_array(column).alias("values"))


CLASSIFIERS = {
    "logistic_regression": lambda: cl.LogisticRegression(maxIter=5), "linear_svm": lambda: cl.LinearSVC(maxIter=5), "decision_tree": lambda: cl.DecisionTreeClassifier(maxDepth=3),
    "random_forest": lambda: cl.RandomForestClassifier(numTrees=5, maxDepth=3, seed=1), "gbt": lambda: cl.GBTClassifier(maxIter=2, maxDepth=2, seed=1), "naive_bayes": lambda: cl.NaiveBayes(),
    "multilayer_perceptron": lambda: cl.MultilayerPerceptronClassifier(layers=[3, 4, 2], maxIter=5, seed=1), "one_vs_rest": lambda: cl.OneVsRest(classifier=cl.LogisticRegression(maxIter=3)),
}
REGRESSIONS = {
    "linear_regression": lambda: rg.LinearRegression(labelCol="number"), "lasso": lambda: rg.LinearRegression(labelCol="number", elasticNetParam=1.0, regParam=0.1), "ridge": lambda: rg.LinearRegression(labelCol="number", regParam=0.1),
    "decision_tree_regression": lambda: rg.DecisionTreeRegressor(labelCol="number", maxDepth=3), "random_forest_regression": lambda: rg.RandomForestRegressor(labelCol="number", numTrees=3, maxDepth=3, seed=1),
    "gbt_regression": lambda: rg.GBTRegressor(labelCol="number", maxIter=2, maxDepth=2, seed=1), "isotonic_regression": lambda: rg.IsotonicRegression(labelCol="number", featuresCol="l_quantity"),
}
CLUSTERINGS = {
    "kmeans": lambda: cu.KMeans(k=3, seed=1), "bisecting_kmeans": lambda: cu.BisectingKMeans(k=3, seed=1), "gaussian_mixture": lambda: cu.GaussianMixture(k=2, maxIter=3, seed=1),
}
VECTORS = {
    "standard_scaler": lambda: fe.StandardScaler(inputCol="features", outputCol="out"), "min_max_scaler": lambda: fe.MinMaxScaler(inputCol="features", outputCol="out"), "normalizer": lambda: fe.Normalizer(inputCol="features", outputCol="out"),
    "pca": lambda: fe.PCA(k=2, inputCol="features", outputCol="out"), "dct": lambda: fe.DCT(inputCol="features", outputCol="out"), "polynomial_expansion": lambda: fe.PolynomialExpansion(inputCol="features", outputCol="out"),
    "vector_slicer": lambda: fe.VectorSlicer(inputCol="features", outputCol="out", indices=[0]), "vector_indexer": lambda: fe.VectorIndexer(inputCol="features", outputCol="out", maxCategories=4),
    "elementwise_product": lambda: fe.ElementwiseProduct(inputCol="features", outputCol="out", scalingVec=[1.0, 2.0, 3.0]), "interaction": lambda: fe.Interaction(inputCols=["features", "label"], outputCol="out"),
    "chi_sq_selector": lambda: fe.ChiSqSelector(numTopFeatures=1, featuresCol="features", labelCol="label", outputCol="out"),
}
WORDS = {
    "hashing_tf": lambda: fe.HashingTF(inputCol="words", outputCol="out", numFeatures=64), "count_vectorizer": lambda: fe.CountVectorizer(inputCol="words", outputCol="out", vocabSize=50),
    "word2vec": lambda: fe.Word2Vec(inputCol="words", outputCol="out", vectorSize=4, minCount=2, maxIter=1, seed=1), "idf": lambda: Pipeline(stages=[fe.HashingTF(inputCol="words", outputCol="tf", numFeatures=64), fe.IDF(inputCol="tf", outputCol="out")]),
}


def _fitted(stage, df: DataFrame) -> DataFrame:
    return (stage.fit(df) if hasattr(stage, "fit") else stage).transform(df)


for _n, _s in CLASSIFIERS.items():
    QUERIES[f"ml_{_n}"] = lambda t, s=_s: counted(_fitted(s(), points(t)), "prediction")
for _n, _s in REGRESSIONS.items():
    QUERIES[f"ml_{_n}"] = lambda t, s=_s: _fitted(s(), points(t)).agg(F.round(F.avg(F.abs(F.col("prediction") - F.col("number"))), 2).alias("mean_error"))
for _n, _s in CLUSTERINGS.items():
    QUERIES[f"ml_{_n}"] = lambda t, s=_s: counted(_fitted(s(), points(t)), "prediction")
for _n, _s in VECTORS.items():
    QUERIES[f"ml_{_n}"] = lambda t, s=_s: as_text(_fitted(s(), points(t)), "out", "number")
for _n, _s in WORDS.items():
    QUERIES[f"ml_{_n}"] = lambda t, s=_s: as_text(_fitted(s(), texts(t)), "out", "item_id")


def ml(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@ml
def ml_als(t: Tables) -> DataFrame:
    seen = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item")).agg(F.sum("l_quantity").alias("rating"))
    return rec.ALS(rank=4, maxIter=2, seed=1).fit(seen).transform(seen).agg(F.count("prediction").alias("n"))


@ml
def ml_lda(t: Tables) -> DataFrame:
    counts = fe.CountVectorizer(inputCol="words", outputCol="features", vocabSize=100).fit(texts(t)).transform(texts(t))
    return as_text(cu.LDA(k=3, maxIter=2, seed=1).fit(counts).transform(counts), "topicDistribution", "item_id")


@ml
def ml_power_iteration(t: Tables) -> DataFrame:
    links = t("nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst"))
    return cu.PowerIterationClustering(k=2, maxIter=5).assignClusters(links)


@ml
def ml_fp_growth(t: Tables) -> DataFrame:
    baskets = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("items"))
    return fpm.FPGrowth(minSupport=0.02, minConfidence=0.02).fit(baskets).freqItemsets


@ml
def ml_prefix_span(t: Tables) -> DataFrame:
    steps = t("events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_type"))), lambda x: F.array(x["event_type"])).alias("sequence"))
    return fpm.PrefixSpan(minSupport=0.6, maxPatternLength=3).findFrequentSequentialPatterns(steps)


@ml
def ml_aft_regression(t: Tables) -> DataFrame:
    df = points(t).select("features", F.col("l_quantity").alias("label"), F.lit(1.0).alias("censor"))
    return _fitted(rg.AFTSurvivalRegression(maxIter=5), df).agg(F.count("prediction").alias("n"))


@ml
def ml_text_stages(t: Tables) -> DataFrame:
    stages = [fe.Tokenizer(inputCol="text", outputCol="w"), fe.StopWordsRemover(inputCol="w", outputCol="kept"), fe.NGram(n=2, inputCol="kept", outputCol="pairs")]
    return Pipeline(stages=stages).fit(t("benchmark")).transform(t("benchmark")).select("item_id", F.size("pairs").alias("n"))


@ml
def ml_table_stages(t: Tables) -> DataFrame:
    stages = [
        fe.StringIndexer(inputCol="p_brand", outputCol="brand"), fe.OneHotEncoder(inputCol="brand", outputCol="hot"), fe.Binarizer(inputCol="p_retailprice", outputCol="dear", threshold=950.0),
        fe.Bucketizer(inputCol="p_retailprice", outputCol="bucket", splits=[-float("inf"), 920.0, 960.0, float("inf")]), fe.QuantileDiscretizer(inputCol="p_retailprice", outputCol="quantile", numBuckets=4),
        fe.SQLTransformer(statement="SELECT *, p_size * 2 AS twice FROM __THIS__"), fe.RFormula(formula="dear ~ p_size + p_type"),
    ]
    return Pipeline(stages=stages).fit(t("part")).transform(t("part")).groupBy("bucket", "quantile", "dear").agg(F.count("*").alias("n"))


@ml
def ml_evaluation(t: Tables) -> DataFrame:
    df = points(t)
    found = cl.LogisticRegression(maxIter=3).fit(df).transform(df)
    number = rg.LinearRegression(labelCol="number", maxIter=3).fit(df).transform(df)
    rows = [("auc", ev.BinaryClassificationEvaluator().evaluate(found)), ("f1", ev.MulticlassClassificationEvaluator().evaluate(found)), ("rmse", ev.RegressionEvaluator(labelCol="number").evaluate(number))]
    return df.sparkSession.createDataFrame(rows, "metric string, value double")


@ml
def ml_tuning(t: Tables) -> DataFrame:
    df, lr = points(t), cl.LogisticRegression(maxIter=2)
    grid = tuning.ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).build()
    cv = tuning.CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=ev.BinaryClassificationEvaluator(), numFolds=2, seed=1).fit(df)
    tv = tuning.TrainValidationSplit(estimator=lr, estimatorParamMaps=grid, evaluator=ev.BinaryClassificationEvaluator(), seed=1).fit(df)
    return df.sparkSession.createDataFrame([("cv", float(max(cv.avgMetrics))), ("split", float(max(tv.validationMetrics)))], "how string, best double")


@ml
def ml_statistics(t: Tables) -> DataFrame:
    df = points(t)
    chi = stat.ChiSquareTest.test(df, "features", "label").select(vector_to_array("pValues").alias("values"))
    ks = stat.KolmogorovSmirnovTest.test(df, "l_quantity", "norm", 25.0, 15.0).select(F.array("pValue").alias("values"))
    names, matrix = ("l_quantity", "l_discount", "l_tax"), stat.Correlation.corr(df, "features").first()[0].toArray()
    both = df.sparkSession.createDataFrame([([round(float(matrix[i, j]), 9)], f"corr {names[i]} {names[j]}") for i in range(3) for j in range(i)], "values array<double>, test string")
    return chi.withColumn("test", F.lit("chi")).union(ks.withColumn("test", F.lit("ks"))).union(both)


@ml
def ml_association_rules(t: Tables) -> DataFrame:
    baskets = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("items"))
    return fpm.FPGrowth(minSupport=0.2, minConfidence=0.5).fit(baskets).associationRules.select(F.concat_ws(",", F.sort_array("antecedent")).alias("given"), F.concat_ws(",", "consequent").alias("then"), "confidence")


@ml
def ml_ranking_metrics(t: Tables) -> DataFrame:
    rows = t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.col("o_orderkey").cast("double"))).alias("label"), F.sort_array(F.collect_set(F.col("o_orderkey").cast("double")), asc=False).alias("prediction"))
    return rows.sparkSession.createDataFrame([("map", float(ev.RankingEvaluator().evaluate(rows)))], "metric string, value double")


@ml
def ml_multilabel_metrics(t: Tables) -> DataFrame:
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("double")).alias("label"), F.collect_set(F.least(F.col("l_linenumber"), F.lit(5)).cast("double")).alias("prediction"))
    return rows.sparkSession.createDataFrame([("f1", float(ev.MultilabelClassificationEvaluator().evaluate(rows)))], "metric string, value double")


@ml
def ml_matrices(t: Tables) -> DataFrame:
    """A coordinate matrix as blocks, times its transpose, as indexed rows."""
    from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry

    entries = t("nation").select("n_nationkey", "n_regionkey").rdd.map(lambda r: MatrixEntry(r[0], r[1], 1.0))
    a = CoordinateMatrix(entries).toBlockMatrix(8, 8)
    product = a.transpose().multiply(a).toIndexedRowMatrix()
    return product.rows.map(lambda r: (int(r.index), float(r.vector.toArray().sum()))).toDF("row long, sum double")


@ml
def ml_kernel_density(t: Tables) -> DataFrame:
    from pyspark.mllib.stat import KernelDensity

    k = KernelDensity()
    k.setBandwidth(500.0)
    k.setSample(t("customer").select(F.col("c_acctbal").cast("double")).rdd.map(lambda r: r[0]))
    return t("customer").sparkSession.createDataFrame([(float(x), float(y)) for x, y in zip((0.0, 5000.0), k.estimate([0.0, 5000.0]))], "at double, density double")


@ml
def ml_streaming_kmeans(t: Tables) -> DataFrame:
    """Batches of points update the centres in turn."""
    from pyspark.mllib.clustering import StreamingKMeansModel
    from pyspark.mllib.linalg import Vectors

    model = StreamingKMeansModel([[10.0], [40.0]], [1.0, 1.0])
    number = F.pmod(F.coalesce("l_linenumber", F.lit(0)), F.lit(7))  # every line is in one of the batches
    for k in range(7):
        batch = t("lineitem").where(number == k).select("l_quantity").rdd.map(lambda r: Vectors.dense(r[0]))
        model = model.update(batch, 0.5, "batches")
    return t("lineitem").sparkSession.createDataFrame([(float(c[0]),) for c in model.centers], "centre double")


@ml
def ml_sliding(t: Tables) -> DataFrame:
    """Sliding windows of three over an order, as a moving mean."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").rowsBetween(0, 2)
    return t("lineitem").select("l_orderkey", F.round(F.avg("l_quantity").over(w), 4).alias("mean"))


@ml
def ml_libsvm(t: Tables) -> DataFrame:
    """Labelled points written and read in the LibSVM format."""
    import uuid

    from quern.session import shared_dir

    df = points(t).select("label", "features")
    path = f"{shared_dir(df.sparkSession)}/libsvm-{uuid.uuid4().hex}"
    df.write.format("libsvm").save(path)
    return counted(df.sparkSession.read.format("libsvm").option("numFeatures", 3).load(path), "label")
