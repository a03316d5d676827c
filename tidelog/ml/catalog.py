"""Queries that fit and apply estimators and transformers of pyspark.ml, with SQL where the result has a closed form.

Fitting is distributed; what reaches the driver is a model's parameters. Seeds are fixed, and models without a closed form
return their predictions counted by label, so a result is small whatever the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import evaluation as E
from pyspark.ml import feature as X
from pyspark.ml import regression as R
from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.stat import ChiSquareTest, Correlation, KolmogorovSmirnovTest, Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LINE = "l_orderkey, l_linenumber"
KEY = LINE.split(", ")
WORDS = "SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS term FROM part"


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function of `table(name)` as query ml_<its name>."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f"ml_{f.__name__}"] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f"ml_{f.__name__}"] = sql
        return f

    return register


def assembled(df: DataFrame, *columns: str) -> DataFrame:
    return X.VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


def spread(df: DataFrame, vector: str, names: list[str], *keys: str) -> DataFrame:
    """The keys and a column for each component of a vector."""
    return df.select(*keys, *(vector_to_array(vector)[k].alias(n) for k, n in enumerate(names)))


def one_row(df: DataFrame, **values: float) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


def lines(t: Tables) -> DataFrame:
    """Lines with numbers to learn from: quantity, price, discount, tax, and whether they were returned."""
    number = [F.col(f"l_{c}").cast("double").alias(c) for c in ("quantity", "extendedprice", "discount", "tax")]
    return t("lineitem").select(*KEY, *number, (F.col("l_returnflag") == "R").cast("double").alias("label"), "l_returnflag", "l_linestatus").withColumnRenamed("extendedprice", "price")


def worth(t: Tables) -> DataFrame:
    """Lines with a label that follows the quantity."""
    return assembled(lines(t).withColumn("worth", F.col("quantity") * 1000 + F.col("tax")), "quantity")


# features


@query(f"SELECT {LINE}, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM lineitem")
def binarizer(t):
    return X.Binarizer(threshold=25, inputCol="quantity", outputCol="y").transform(lines(t)).select(*KEY, "y")


@query(f"SELECT {LINE}, CASE WHEN l_quantity < 10 THEN 0.0 WHEN l_quantity < 30 THEN 1.0 ELSE 2.0 END::DOUBLE AS y FROM lineitem")
def bucketizer(t):
    return X.Bucketizer(splits=[float("-inf"), 10, 30, float("inf")], inputCol="quantity", outputCol="y").transform(lines(t)).select(*KEY, "y")


@query("SELECT 4 AS buckets, true AS even")
def quantile_discretizer(t):
    """Its quantiles are approximate: whether four buckets come out, each of about a quarter of the rows."""
    made = X.QuantileDiscretizer(numBuckets=4, inputCol="price", outputCol="y", relativeError=0.001).fit(lines(t)).transform(lines(t))
    counts = made.groupBy("y").count()
    return counts.agg(F.count(F.lit(1)).cast("int").alias("buckets"), (F.max("count") < 1.2 * F.min("count")).alias("even"))


@query(f"SELECT {LINE}, l_quantity * 2.0 AS a, l_extendedprice * 0.5 AS b FROM lineitem")
def elementwise_product(t):
    made = X.ElementwiseProduct(scalingVec=[2.0, 0.5], inputCol="features", outputCol="y").transform(assembled(lines(t), "quantity", "price"))
    return spread(made, "y", ["a", "b"], *KEY)


def _scaled(name: str, estimator: Callable[[], X.JavaEstimator], sql: str) -> None:
    def run(t: Tables) -> DataFrame:
        df = assembled(lines(t), "quantity", "price")
        made = estimator().setInputCol("features").setOutputCol("y").fit(df).transform(df)
        return made.select(*KEY, *(F.round(vector_to_array("y")[k], 6).alias(n) for k, n in enumerate("ab")))

    run.__name__ = name
    query(f"SELECT {LINE}, round({sql.format(x='l_quantity')}, 6) AS a, round({sql.format(x='l_extendedprice')}, 6) AS b FROM lineitem")(run)


_scaled("min_max_scaler", X.MinMaxScaler, "({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ())")
_scaled("standard_scaler", lambda: X.StandardScaler(withMean=True), "({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER ()")


@query(f"SELECT {LINE}, round(l_quantity / sqrt(l_quantity ** 2 + l_discount ** 2), 6) AS a, round(l_discount / sqrt(l_quantity ** 2 + l_discount ** 2), 6) AS b FROM lineitem")
def normalizer(t):
    made = X.Normalizer(p=2.0, inputCol="features", outputCol="y").transform(assembled(lines(t), "quantity", "discount"))
    return made.select(*KEY, *(F.round(vector_to_array("y")[k], 6).alias(n) for k, n in enumerate("ab")))


@query(f"SELECT {LINE}, l_quantity::DOUBLE AS x, (l_quantity ** 2)::DOUBLE AS xx, l_tax::DOUBLE AS y, (l_quantity * l_tax)::DOUBLE AS xy, (l_tax ** 2)::DOUBLE AS yy FROM lineitem")
def polynomial_expansion(t):
    made = X.PolynomialExpansion(degree=2, inputCol="features", outputCol="z").transform(assembled(lines(t), "quantity", "tax"))
    return spread(made, "z", ["x", "xx", "y", "xy", "yy"], *KEY)


@query(f"SELECT {LINE}, (l_quantity * l_discount)::DOUBLE AS a, (l_quantity * l_tax)::DOUBLE AS b FROM lineitem")
def interaction(t):
    made = X.Interaction(inputCols=["quantity", "features"], outputCol="y").transform(assembled(lines(t), "discount", "tax"))
    return spread(made, "y", ["a", "b"], *KEY)


@query(f"SELECT {LINE}, l_tax::DOUBLE AS a, l_quantity::DOUBLE AS b FROM lineitem")
def vector_slicer(t):
    made = X.VectorSlicer(inputCol="features", outputCol="y", indices=[2, 0]).transform(assembled(lines(t), "quantity", "price", "tax"))
    return spread(made, "y", ["a", "b"], *KEY)


@query(f"SELECT {LINE}, round(l_quantity, 6)::DOUBLE AS a, round(l_discount, 6)::DOUBLE AS b, round(l_tax, 6)::DOUBLE AS c FROM lineitem")
def dct(t):
    """There and back."""
    there = X.DCT(inputCol="features", outputCol="y").transform(assembled(lines(t), "quantity", "discount", "tax"))
    back = X.DCT(inverse=True, inputCol="y", outputCol="z").transform(there)
    return back.select(*KEY, *((F.round(vector_to_array("z")[k], 6) + 0.0).alias(n) for k, n in enumerate("abc")))


INDEXED = "SELECT l_returnflag AS flag, (row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1)::DOUBLE AS y FROM lineitem GROUP BY 1"


@query(INDEXED)
def string_indexer(t):
    df = lines(t)
    return X.StringIndexer(inputCol="l_returnflag", outputCol="y").fit(df).transform(df).select(F.col("l_returnflag").alias("flag"), "y").distinct()


@query(INDEXED)
def index_to_string(t):
    df = lines(t)
    made = X.StringIndexer(inputCol="l_returnflag", outputCol="y").fit(df).transform(df)
    return X.IndexToString(inputCol="y", outputCol="flag").transform(made).select("flag", "y").distinct()


@query(f"SELECT flag, (y = 0)::INT::DOUBLE AS a, (y = 1)::INT::DOUBLE AS b FROM ({INDEXED}) q")
def one_hot_encoder(t):
    df = lines(t)
    made = X.StringIndexer(inputCol="l_returnflag", outputCol="i").fit(df).transform(df)
    made = X.OneHotEncoder(inputCols=["i"], outputCols=["y"]).fit(made).transform(made)
    return spread(made.withColumn("flag", F.col("l_returnflag")), "y", ["a", "b"], "flag").distinct()


def tokens(t: Tables) -> DataFrame:
    return X.Tokenizer(inputCol="p_name", outputCol="terms").transform(t("part"))


@query(WORDS)
def tokenizer(t):
    return tokens(t).select("p_partkey", F.explode("terms").alias("term"))


@query("SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS term FROM part")
def regex_tokenizer(t):
    return X.RegexTokenizer(pattern="[a-z]+", gaps=False, inputCol="p_name", outputCol="terms").transform(t("part")).select("p_partkey", F.explode("terms").alias("term"))


@query(f"SELECT * FROM ({WORDS}) q WHERE term NOT IN ('steel', 'red')")
def stop_words_remover(t):
    return X.StopWordsRemover(stopWords=["steel", "red"], inputCol="terms", outputCol="left").transform(tokens(t)).select("p_partkey", F.explode("left").alias("term"))


@query("SELECT p_partkey, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part) q")
def n_gram(t):
    return X.NGram(n=2, inputCol="terms", outputCol="pairs").transform(tokens(t)).select("p_partkey", F.explode("pairs").alias("pair"))


@query(f"SELECT p_partkey, term, count(*)::DOUBLE AS n FROM ({WORDS}) q GROUP BY 1, 2")
def count_vectorizer(t):
    model = X.CountVectorizer(inputCol="terms", outputCol="y").fit(tokens(t))
    words = F.array(*map(F.lit, model.vocabulary))
    made = model.transform(tokens(t)).select("p_partkey", F.posexplode(vector_to_array("y"))).where("col > 0")
    return made.select("p_partkey", words[F.col("pos")].alias("term"), F.col("col").alias("n"))


@query(f"SELECT p_partkey, count(*)::DOUBLE AS n FROM ({WORDS}) q GROUP BY 1")
def hashing_tf(t):
    """A part's counts add up to its words, whatever places they are hashed to."""
    made = X.HashingTF(inputCol="terms", outputCol="y", numFeatures=64).transform(tokens(t))
    return made.select("p_partkey", F.aggregate(vector_to_array("y"), F.lit(0.0), lambda a, b: a + b).alias("n"))


@query(f"SELECT term, round(ln(((SELECT count(*) FROM part) + 1) / (count(DISTINCT p_partkey) + 1)), 6) AS idf FROM ({WORDS}) q GROUP BY 1")
def idf(t):
    model = X.CountVectorizer(inputCol="terms", outputCol="counts").fit(tokens(t))
    weights = X.IDF(inputCol="counts", outputCol="y").fit(model.transform(tokens(t))).idf.toArray()
    return t("part").sparkSession.createDataFrame([*zip(model.vocabulary, map(float, weights), strict=True)], "term string, w double").select("term", F.round("w", 6).alias("idf"))


@query(f"SELECT term FROM ({WORDS}) q GROUP BY 1 HAVING count(*) >= 5")
def word2vec(t):
    """The words that get a vector."""
    return X.Word2Vec(vectorSize=4, minCount=5, seed=7, numPartitions=1, inputCol="terms", outputCol="y").fit(tokens(t)).getVectors().select(F.col("word").alias("term"))


@query("SELECT round(((a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b)) / (a + d), 6) AS share FROM (SELECT var_samp(l_quantity) AS a, var_samp(l_tax * 100) AS d, covar_samp(l_quantity, l_tax * 100) AS b FROM lineitem) q")
def pca(t):
    df = assembled(lines(t).withColumn("tax100", F.col("tax") * 100), "quantity", "tax100")
    return one_row(df, share=round(X.PCA(k=1, inputCol="features", outputCol="y").fit(df).explainedVariance[0], 6))


@query("SELECT l_quantity * 2.0 AS twice, l_returnflag FROM lineitem WHERE l_tax > 0.04")
def sql_transformer(t):
    return X.SQLTransformer(statement="SELECT l_quantity * 2.0D AS twice, l_returnflag FROM __THIS__ WHERE l_tax > 0.04").transform(t("lineitem"))


@query(f"SELECT {LINE}, l_quantity::DOUBLE AS label, l_extendedprice::DOUBLE AS price FROM lineitem")
def r_formula(t):
    df = lines(t).drop("label")
    made = X.RFormula(formula="quantity ~ price + l_linestatus", featuresCol="f", labelCol="y").fit(df).transform(df)
    return made.select(*KEY, F.col("y").alias("label"), vector_to_array("f")[0].alias("price"))


@query("SELECT 1::DOUBLE AS chosen")
def chi_square_selector(t):
    """Of a column that is the label and one that is constant, the first is chosen."""
    df = assembled(lines(t).select((1 - F.col("label")).alias("same"), F.lit(1.0).alias("none"), "label"), "none", "same")
    return one_row(df, chosen=X.ChiSqSelector(numTopFeatures=1, featuresCol="features", labelCol="label", outputCol="y").fit(df).selectedFeatures[0])


# statistics


@query("SELECT count(*)::DOUBLE AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance, min(l_quantity)::DOUBLE AS least, max(l_quantity)::DOUBLE AS most FROM lineitem")
def summarizer(t):
    s = Summarizer.metrics("count", "mean", "variance", "min", "max").summary(F.col("features")).alias("s")
    r = assembled(lines(t), "quantity").select(s).first()["s"]
    return one_row(t("lineitem"), n=r["count"], mean=round(r["mean"][0], 6), variance=round(r["variance"][0], 6), least=r["min"][0], most=r["max"][0])


RANKED = "(SELECT avg(n) OVER (PARTITION BY a) AS a, avg(m) OVER (PARTITION BY b) AS b FROM (SELECT l_quantity AS a, l_extendedprice AS b, row_number() OVER (ORDER BY l_quantity) AS n, row_number() OVER (ORDER BY l_extendedprice) AS m FROM lineitem) q) z"


@query(f"SELECT round((SELECT corr(l_quantity, l_extendedprice) FROM lineitem), 6) AS pearson, round((SELECT corr(a, b) FROM {RANKED}), 6) AS spearman")
def correlation(t):
    df = assembled(lines(t), "quantity", "price")
    found = {m: round(Correlation.corr(df, "features", m).first()[0][0, 1], 6) for m in ("pearson", "spearman")}
    return one_row(df, **found)


@query("SELECT round(sum((o - e) ** 2 / e), 4) AS statistic FROM (SELECT coalesce(n, 0) AS o, x.c * y.c / (SELECT count(*) FROM lineitem) AS e FROM (SELECT l_linestatus AS s, count(*)::DOUBLE AS c FROM lineitem GROUP BY 1) x CROSS JOIN (SELECT l_returnflag = 'R' AS r, count(*)::DOUBLE AS c FROM lineitem GROUP BY 1) y LEFT JOIN (SELECT l_linestatus AS s, l_returnflag = 'R' AS r, count(*) AS n FROM lineitem GROUP BY 1, 2) z ON x.s = z.s AND y.r = z.r) q")
def chi_square_test(t):
    df = assembled(lines(t).withColumn("open", (F.col("l_linestatus") == "O").cast("double")), "open")
    return one_row(df, statistic=round(ChiSquareTest.test(df, "features", "label").first()["statistics"][0], 4))


@query()
def kolmogorov_smirnov_test(t):
    r = KolmogorovSmirnovTest.test(lines(t), "quantity", "norm", 25.0, 15.0).first()
    return one_row(t("lineitem"), statistic=round(r["statistic"], 6))


@query("SELECT x::DOUBLE AS x, round(avg(exp(-1 * (((l_quantity - x) / 3.0) ** 2) / 2) / (3.0 * sqrt(2 * pi()))), 8) AS density FROM lineitem CROSS JOIN (VALUES (10), (25), (40)) v(x) GROUP BY 1")
def kernel_density(t):
    """A Gaussian kernel's density at three points, in one pass over the rows."""
    points = (10.0, 25.0, 40.0)
    pdf = [F.avg(F.exp(-(((F.col("quantity") - x) / 3.0) ** 2) / 2) / (3.0 * (2 * 3.141592653589793) ** 0.5)) for x in points]
    r = lines(t).agg(*pdf).first()
    return t("lineitem").sparkSession.createDataFrame([(x, round(d, 8)) for x, d in zip(points, r, strict=True)], "x double, density double")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_by_key(t):
    best = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t("orders").withColumn("n", best).where("n <= 2").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM orders")
def sliding(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return t("orders").select("o_orderkey", F.avg("o_totalprice").over(w).alias("m"))


# regression


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS start, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def linear_regression(t):
    model = R.LinearRegression(labelCol="price", solver="normal").fit(assembled(lines(t), "quantity"))
    return one_row(t("lineitem"), slope=round(model.coefficients[0], 4), start=round(model.intercept, 2), r2=round(model.summary.r2, 6))


@query("SELECT round((sw * swxy - swx * swy) / (sw * swxx - swx * swx), 3) AS slope FROM (SELECT sum(w) AS sw, sum(w * x) AS swx, sum(w * y) AS swy, sum(w * x * y) AS swxy, sum(w * x * x) AS swxx FROM (SELECT l_tax::DOUBLE + 1 AS w, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem) q) z")
def weighted_least_squares(t):
    df = assembled(lines(t).withColumn("w", F.col("tax") + 1), "quantity")
    return one_row(df, slope=round(R.LinearRegression(labelCol="price", weightCol="w", solver="normal").fit(df).coefficients[0], 3))


@query("SELECT 0::DOUBLE AS lasso, true AS shrunk")
def ridge_and_lasso(t):
    """A strong enough penalty takes the lasso's coefficient to nothing and makes that of ridge regression smaller."""
    df = worth(t)
    fit = lambda **o: R.LinearRegression(labelCol="worth", **o).fit(df).coefficients[0]
    plain, ridge, lasso = fit(), fit(regParam=1.0), fit(regParam=1e7, elasticNetParam=1.0)
    return t("lineitem").sparkSession.createDataFrame([(float(lasso), bool(0 < ridge < plain))], "lasso double, shrunk boolean")


@query("SELECT true AS rising")
def isotonic_regression(t):
    model = R.IsotonicRegression(labelCol="price", featuresCol="quantity").fit(lines(t))
    p = model.predictions.toArray()
    return t("lineitem").sparkSession.createDataFrame([(bool((p[1:] >= p[:-1]).all()),)], "rising boolean")


def _learner(name: str, make: Callable[[], object], *columns: str, label: str = "label") -> None:
    """Fits on all lines and counts them by label and prediction; a regressor's error must be below the label's spread."""

    def run(t: Tables) -> DataFrame:
        df = assembled(lines(t), *columns)
        made = make().setLabelCol(label).fit(df).transform(df)
        if label == "label":
            return made.groupBy("label").agg(F.count("prediction").alias("n"))
        error = E.RegressionEvaluator(labelCol=label).evaluate(made)
        return df.agg((F.stddev_pop(label) > error).alias("better"))

    run.__name__ = name
    query("SELECT (l_returnflag = 'R')::INT::DOUBLE AS label, count(*) AS n FROM lineitem GROUP BY 1" if label == "label" else "SELECT true AS better")(run)


for _name, _make in {
    "decision_tree_classifier": lambda: C.DecisionTreeClassifier(maxDepth=3, seed=1),
    "gbt_classifier": lambda: C.GBTClassifier(maxDepth=2, maxIter=2, seed=1),
    "random_forest_classifier": lambda: C.RandomForestClassifier(numTrees=3, maxDepth=3, seed=1),
    "naive_bayes": lambda: C.NaiveBayes(),
    "logistic_regression": lambda: C.LogisticRegression(maxIter=5),
    "linear_svc": lambda: C.LinearSVC(maxIter=3),
    "multilayer_perceptron": lambda: C.MultilayerPerceptronClassifier(layers=[2, 3, 2], maxIter=5, seed=1),
    "one_vs_rest": lambda: C.OneVsRest(classifier=C.LogisticRegression(maxIter=3)),
}.items():
    _learner(_name, _make, "quantity", "price")
for _name, _make in {
    "decision_tree_regressor": lambda: R.DecisionTreeRegressor(maxDepth=3, seed=1),
    "gbt_regressor": lambda: R.GBTRegressor(maxDepth=2, maxIter=2, seed=1),
    "random_forest_regressor": lambda: R.RandomForestRegressor(numTrees=3, maxDepth=3, seed=1),
}.items():
    _learner(_name, _make, "quantity", label="price")


# clusters, patterns, recommendations


def _clusters(name: str, make: Callable[[], object]) -> None:
    def run(t: Tables) -> DataFrame:
        df = assembled(t("customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("x")), "x")
        return make().fit(df).transform(df).agg(F.count("prediction").alias("n"), (F.count_distinct("prediction") > 1).alias("several"))

    run.__name__ = name
    query("SELECT count(*) AS n, true AS several FROM customer")(run)


for _name, _make in {
    "k_means": lambda: K.KMeans(k=3, seed=1),
    "bisecting_k_means": lambda: K.BisectingKMeans(k=3, seed=1),
    "gaussian_mixture": lambda: K.GaussianMixture(k=2, seed=1, maxIter=10),
}.items():
    _clusters(_name, _make)


@query("SELECT count(*) AS n FROM part")
def lda(t):
    made = X.CountVectorizer(inputCol="terms", outputCol="features").fit(tokens(t)).transform(tokens(t))
    topics = K.LDA(k=2, seed=1, maxIter=2).fit(made).transform(made)
    whole = F.aggregate(vector_to_array("topicDistribution"), F.lit(0.0), lambda a, b: a + b)
    return topics.where(F.abs(whole - 1) < 1e-6).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM nation")
def power_iteration_clustering(t):
    a, b = (t("nation").select(F.col("n_nationkey").alias(c), F.col("n_regionkey").alias(r)) for c, r in (("src", "r"), ("dst", "s")))
    near = a.join(F.broadcast(b), F.col("src") < F.col("dst")).withColumn("w", F.when(F.col("r") == F.col("s"), 10.0).otherwise(0.1))
    return K.PowerIterationClustering(k=5, maxIter=10, weightCol="w").assignClusters(near).agg(F.count(F.lit(1)).alias("n"))


PAIRS = "(SELECT DISTINCT l_orderkey AS k, l_returnflag || l_linestatus AS i FROM lineitem)"
ITEMS = f"SELECT i AS items, count(*) AS n FROM {PAIRS} q GROUP BY 1 UNION ALL SELECT a.i || ',' || b.i, count(*) FROM {PAIRS} a JOIN {PAIRS} b ON a.k = b.k AND a.i < b.i GROUP BY 1"


def baskets(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("items"))


@query(f"SELECT * FROM ({ITEMS}) z WHERE n >= 0.05 * (SELECT count(DISTINCT l_orderkey) FROM lineitem)")
def fp_growth(t):
    found = FPGrowth(itemsCol="items", minSupport=0.05).fit(baskets(t)).freqItemsets.where(F.size("items") <= 2)
    return found.select(F.array_join(F.sort_array("items"), ",").alias("items"), F.col("freq").alias("n"))


@query(f"SELECT a, b, round(n / m, 6) AS confidence FROM (SELECT x.i AS a, y.i AS b, count(*) AS n FROM {PAIRS} x JOIN {PAIRS} y ON x.k = y.k AND x.i <> y.i GROUP BY 1, 2) p JOIN (SELECT i, count(*) AS m FROM {PAIRS} q GROUP BY 1) s ON s.i = a WHERE n >= 0.05 * (SELECT count(DISTINCT l_orderkey) FROM lineitem) AND n / m >= 0.3")
def association_rules(t):
    rules = FPGrowth(itemsCol="items", minSupport=0.05, minConfidence=0.3).fit(baskets(t)).associationRules.where(F.size("antecedent") == 1)
    return rules.select(F.col("antecedent")[0].alias("a"), F.col("consequent")[0].alias("b"), F.round("confidence", 6).alias("confidence"))


@query("SELECT l_returnflag AS a, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 0.2 * (SELECT count(DISTINCT l_orderkey) FROM lineitem)")
def prefix_span(t):
    """The frequent sequences of one item."""
    rows = t("lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda s: F.array(s["l_returnflag"])).alias("sequence"))
    found = PrefixSpan(minSupport=0.2, maxPatternLength=2).findFrequentSequentialPatterns(rows)
    return found.where((F.size("sequence") == 1) & (F.size(F.col("sequence")[0]) == 1)).select(F.col("sequence")[0][0].alias("a"), F.col("freq").alias("n"))


@query("SELECT count(*) AS n, true AS near FROM (SELECT DISTINCT o_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) q")
def als(t):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    ratings = joined.groupBy(F.col("o_custkey").cast("int").alias("u"), F.col("c_nationkey").cast("int").alias("i")).agg(F.count(F.lit(1)).cast("float").alias("r"))
    made = ALS(userCol="u", itemCol="i", ratingCol="r", rank=2, maxIter=3, seed=1, nonnegative=True).fit(ratings).transform(ratings)
    return made.agg(F.count("prediction").alias("n"), (F.avg(F.abs(F.col("prediction") - F.col("r"))) < F.avg("r")).alias("near"))


# evaluation and tuning


@query("SELECT round((sum(CASE WHEN p THEN r END) - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM (SELECT p, avg(k) OVER (PARTITION BY x) AS r, count(*) FILTER (p) OVER () AS n1, count(*) FILTER (NOT p) OVER () AS n0 FROM (SELECT l_quantity AS x, l_returnflag = 'R' AS p, row_number() OVER (ORDER BY l_quantity) AS k FROM lineitem) q) z GROUP BY n1, n0")
def binary_evaluator(t):
    df = lines(t).withColumnRenamed("quantity", "rawPrediction")
    return one_row(df, auc=round(E.BinaryClassificationEvaluator(numBins=0).evaluate(df), 6))


@query("SELECT round(avg((p = y)::INT), 6) AS accuracy FROM (SELECT l_returnflag = 'R' AS y, l_quantity > 25 AS p FROM lineitem) q")
def multiclass_evaluator(t):
    df = lines(t).withColumn("prediction", (F.col("quantity") > 25).cast("double"))
    return one_row(df, accuracy=round(E.MulticlassClassificationEvaluator(metricName="accuracy").evaluate(df), 6))


@query("SELECT round(sqrt(avg((p - y) ** 2)), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae, round(1 - sum((p - y) ** 2) / sum((y - m) ** 2), 6) AS r2 FROM (SELECT l_quantity::DOUBLE * 1000 AS p, l_extendedprice::DOUBLE AS y, avg(l_extendedprice) OVER () AS m FROM lineitem) q")
def regression_evaluator(t):
    df = lines(t).select((F.col("quantity") * 1000).alias("prediction"), F.col("price").alias("label"))
    evaluate = lambda m: E.RegressionEvaluator(metricName=m).evaluate(df)
    return one_row(df, rmse=round(evaluate("rmse"), 4), mae=round(evaluate("mae"), 4), r2=round(evaluate("r2"), 6))


@query("SELECT 1::DOUBLE AS ranking, 1::DOUBLE AS multilabel")
def list_evaluators(t):
    """Of predictions that are the labels."""
    df = baskets(t).select(F.sort_array(F.transform("items", lambda i: F.ascii(i).cast("double"))).alias("label")).withColumn("prediction", F.col("label"))
    df = df.withColumns({c: F.array_distinct(c) for c in ("label", "prediction")})
    return one_row(df, ranking=E.RankingEvaluator().evaluate(df), multilabel=E.MultilabelClassificationEvaluator().evaluate(df))


@query("SELECT 0::DOUBLE AS chosen, 0::DOUBLE AS crossed")
def tuning(t):
    """Both kinds of validation choose no penalty over one that takes all."""
    df = worth(t)
    model = R.LinearRegression(labelCol="worth", elasticNetParam=1.0, maxIter=5)
    tried = {"estimator": model, "estimatorParamMaps": ParamGridBuilder().addGrid(model.regParam, [0.0, 1e7]).build(), "evaluator": E.RegressionEvaluator(labelCol="worth")}
    chosen = [v.fit(df).bestModel.getRegParam() for v in (TrainValidationSplit(**tried, trainRatio=0.7, seed=1), CrossValidator(**tried, numFolds=2, seed=1))]
    return one_row(df, chosen=chosen[0], crossed=chosen[1])


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def pipeline_of_stages(t):
    df = lines(t).drop("label")
    stages = [X.StringIndexer(inputCol="l_returnflag", outputCol="label"), X.VectorAssembler(inputCols=["quantity", "price"], outputCol="raw"), X.StandardScaler(inputCol="raw", outputCol="features"), C.DecisionTreeClassifier(maxDepth=2, seed=1)]
    return Pipeline(stages=stages).fit(df).transform(df).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("prediction").alias("n"))
