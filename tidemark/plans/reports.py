"""More grouped reports, rules and lookups of the inventory, each on the table that stands for its input."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.plans.registry import TIE, query, read

AS_OF = "2024-01-31"


def _events(spark, sf):
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _total(df):
    return df.agg(F.count("*").alias("total"))


@query("""SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS searches, round(avg(value) + 1e-9, 4) AS mean, round(avg(CASE WHEN value < 5 THEN 1.0 ELSE 0.0 END) + 1e-9, 4) AS zero_rate FROM events GROUP BY 1, 2""")
def search_trends(spark, sf):
    return _events(spark, sf).groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("searches"), F.round(F.avg("value") + TIE, 4).alias("mean"), F.round(F.avg(F.when(F.col("value") < 5, 1.0).otherwise(0.0)) + TIE, 4).alias("zero_rate"))


@query("""SELECT user_id, count(*) AS n, CAST(max(ts) AS VARCHAR) AS last_seen FROM events WHERE value < 5 GROUP BY 1 HAVING count(*) > 2""")
def zero_result_searches(spark, sf):
    return _events(spark, sf).where("value < 5").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").cast("string").alias("last_seen")).where("n > 2")


@query("""SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1 ORDER BY n DESC, total DESC, user_id LIMIT 20""")
def top_authors(spark, sf):
    return _events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).orderBy(F.desc("n"), F.desc("total"), "user_id").limit(20)


@query("""SELECT event_type, round(avg(value), 4) AS mean, round(sum(value), 2) AS total, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS median, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS low, round(max(value), 4) AS high FROM events GROUP BY 1""")
def engagement_analysis(spark, sf):
    r = lambda c, n: F.round(c, 4).alias(n)
    return _events(spark, sf).groupBy("event_type").agg(r(F.avg("value"), "mean"), F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"), r(F.percentile("value", 0.5), "median"), r(F.stddev_pop("value"), "std"), r(F.min("value"), "low"), r(F.max("value"), "high"))


@query(f"""SELECT user_id, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-30') AS today, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS week, count(*) AS month FROM events WHERE ts < TIMESTAMP '{AS_OF}' GROUP BY 1""")
def date_buckets(spark, sf):
    e = _events(spark, sf).where(F.col("ts") < F.lit(AS_OF).cast("timestamp"))
    return e.groupBy("user_id").agg(F.count_if(F.to_date("ts") == F.lit("2024-01-30").cast("date")).alias("today"), F.count_if(F.col("ts") >= F.lit("2024-01-24").cast("timestamp")).alias("week"), F.count("*").alias("month"))


@query("""SELECT lang, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 2) AS pct, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def language_distribution(spark, sf):
    d = read(spark, sf, "documents")
    out = d.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).crossJoin(_total(d))  # one total
    return out.select("lang", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("pct"), "chars")


@query("""WITH t AS (SELECT unnest(['excellent', 'good', 'fair', 'poor']) AS tier), c AS (SELECT CASE WHEN n_chars >= 4000 THEN 'excellent' WHEN n_chars >= 1500 THEN 'good' WHEN n_chars >= 300 THEN 'fair' ELSE 'poor' END AS tier, count(*) AS n FROM documents GROUP BY 1) SELECT t.tier, CAST(coalesce(n, 0) AS BIGINT) AS n FROM t LEFT JOIN c USING (tier)""")
def tier_distribution(spark, sf):
    tier = F.when(F.col("n_chars") >= 4000, "excellent").when(F.col("n_chars") >= 1500, "good").when(F.col("n_chars") >= 300, "fair").otherwise("poor")
    counts = read(spark, sf, "documents").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))
    tiers = spark.createDataFrame([(t,) for t in ("excellent", "good", "fair", "poor")], "tier string")
    return tiers.join(counts, "tier", "left").fillna(0, ["n"])


@query("""SELECT source, label, count(*) AS n FROM (SELECT source, CASE WHEN quality = 1 AND toxic = 0 THEN 'keep' WHEN toxic = 1 THEN 'toxic' ELSE 'low' END AS label FROM documents JOIN labels USING (doc_id)) GROUP BY 1, 2""")
def label_performance(spark, sf):
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "keep").when(F.col("toxic") == 1, "toxic").otherwise("low")
    return read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id").groupBy("source", label.alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY CAST(ts AS DATE)) AS BIGINT) AS running FROM events GROUP BY CAST(ts AS DATE)""")
def content_growth(spark, sf):
    days = _events(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))  # one row a day from here
    return days.select(F.col("day").cast("string").alias("day"), "n", F.sum("n").over(Window.orderBy("day")).alias("running"))


@query("""SELECT c_mktsegment, n_name, count(DISTINCT c_custkey) AS members, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def workspace_comparison(spark, sf):
    per = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    out = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(per, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.groupBy("c_mktsegment", "n_name").agg(F.countDistinct("c_custkey").alias("members"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.round(F.coalesce(F.sum("spent"), F.lit(0.0)), 2).alias("spent"))


@query("""SELECT r_name, n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS discount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def campaign_performance(spark, sf):
    lines = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.sum("l_discount").alias("discount"))  # before the joins
    out = lines.join(read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.groupBy("r_name", "n_name").agg(F.sum("lines").alias("lines"), F.round(F.sum("revenue"), 2).alias("revenue"), F.round(F.sum("discount") / F.sum("lines"), 4).alias("discount"))


@query("""SELECT o_orderpriority AS stage, o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1, 2""")
def stage_summary(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query("""SELECT user_id, round(noise, 4) AS noise, n, CASE WHEN noise > 0.5 THEN 'suppress' WHEN noise > 0.3 THEN 'raise threshold' WHEN n > 100 THEN 'digest' ELSE 'keep' END AS advice FROM (SELECT user_id, count(*) AS n, count(*) FILTER (value < 30) * 1.0 / count(*) AS noise FROM events GROUP BY 1)""")
def suppression_advice(spark, sf):
    e = _events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), (F.count_if(F.col("value") < 30) / F.count("*")).alias("noise"))
    return e.select("user_id", F.round("noise", 4).alias("noise"), "n", F.when(F.col("noise") > 0.5, "suppress").when(F.col("noise") > 0.3, "raise threshold").when(F.col("n") > 100, "digest").otherwise("keep").alias("advice"))


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (value >= 50) AS fine, round(count(*) FILTER (value >= 50) * 100.0 / count(*), 2) AS rate, round(avg(value) FILTER (value < 50), 4) AS mean_failed FROM events GROUP BY 1""")
def error_stats(spark, sf):
    good = F.count_if(F.col("value") >= 50)
    return _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("total"), good.alias("fine"), F.round(good * 100.0 / F.count("*"), 2).alias("rate"), F.round(F.avg(F.when(F.col("value") < 50, F.col("value"))), 4).alias("mean_failed"))


@query("""SELECT doc_id, source, round(greatest(1.0, CASE source WHEN 'src1' THEN 1.5 WHEN 'src2' THEN 1.2 WHEN 'src3' THEN 0.5 ELSE 1.0 END) * ln(n_chars + 1) * CASE WHEN lang = 'en' THEN 1.1 ELSE 1.0 END, 4) AS score FROM documents""")
def boosted_scores(spark, sf):
    authority = F.greatest(F.lit(1.0), F.when(F.col("source") == "src1", 1.5).when(F.col("source") == "src2", 1.2).when(F.col("source") == "src3", 0.5).otherwise(1.0))
    return read(spark, sf, "documents").select("doc_id", "source", F.round(authority * F.log(F.col("n_chars") + 1) * F.when(F.col("lang") == "en", 1.1).otherwise(1.0), 4).alias("score"))


@query("""SELECT DISTINCT word AS suggestion FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))) AS word FROM documents WHERE lang = 'en') WHERE starts_with(word, 'tho') ORDER BY 1 LIMIT 50""")
def autocomplete(spark, sf):
    w = read(spark, sf, "documents").where("lang = 'en'").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("suggestion"))
    return w.where(F.col("suggestion").startswith("tho")).distinct().orderBy("suggestion").limit(50)


@query("""WITH v AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents WHERE lang = 'en') WHERE length(word) >= 3 GROUP BY 1 HAVING count(*) >= 5), q AS (SELECT unnest(['teh', 'wiht', 'thsi', 'adn', 'from']) AS typed)
SELECT typed, word AS suggestion, n, CAST(d AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY d, n DESC, word) AS r FROM (SELECT typed, word, n, levenshtein(typed, word) AS d FROM q JOIN v ON abs(length(word) - length(typed)) <= 2) WHERE d <= 2) WHERE r = 1""")
def spelling(spark, sf):
    vocab = read(spark, sf, "documents").where("lang = 'en'").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("length(word) >= 3").groupBy("word").agg(F.count("*").alias("n")).where("n >= 5")
    typed = spark.createDataFrame([(t,) for t in ("teh", "wiht", "thsi", "adn", "from")], "typed string")
    near = vocab.join(F.broadcast(typed), F.abs(F.length("word") - F.length("typed")) <= 2).withColumn("distance", F.levenshtein("typed", "word")).where("distance <= 2")  # five words
    best = near.groupBy("typed").agg(F.min(F.struct("distance", (-F.col("n")).alias("less"), "word")).alias("b"))
    return best.select("typed", F.col("b.word").alias("suggestion"), (-F.col("b.less")).alias("n"), F.col("b.distance").alias("distance"))


@query("""SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS path, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1""")
def conversation_shapes(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.concat_ws(">", F.transform(ordered, lambda r: r["role"])).alias("path"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("""SELECT user_id, count(DISTINCT s) AS sessions, round(avg(n), 4) AS mean_events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY 1, 2) GROUP BY 1""")
def user_sessions(spark, sf):
    s = _events(spark, sf).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.round(F.avg("n"), 4).alias("mean_events"))


@query("""SELECT user_id, next_due, kind FROM (SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' ELSE 'monthly' END AS kind, CAST(max(ts) + CASE user_id % 4 WHEN 0 THEN INTERVAL 1 HOUR WHEN 1 THEN INTERVAL 1 DAY WHEN 2 THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END AS VARCHAR) AS next_due FROM events GROUP BY user_id)""")
def next_due(spark, sf):
    last = _events(spark, sf).groupBy("user_id").agg(F.max("ts").alias("ts"))
    kind = F.expr("CASE user_id % 4 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' ELSE 'monthly' END")
    due = F.expr("ts + CASE user_id % 4 WHEN 0 THEN INTERVAL '1' HOUR WHEN 1 THEN INTERVAL '24' HOUR WHEN 2 THEN INTERVAL '168' HOUR ELSE INTERVAL '720' HOUR END")
    return last.select("user_id", due.cast("string").alias("next_due"), kind.alias("kind"))


@query("""SELECT c_custkey, CASE WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS tier, score FROM (SELECT c_custkey, CAST((CASE WHEN c_acctbal < 0 THEN 3 ELSE 0 END) + (CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 0 END) + (CASE WHEN c_nationkey < 5 THEN 2 ELSE 0 END) AS INTEGER) AS score FROM customer)""")
def impact_assessment(spark, sf):
    score = F.when(F.col("c_acctbal") < 0, 3).otherwise(0) + F.when(F.col("c_mktsegment") == "BUILDING", 2).otherwise(0) + F.when(F.col("c_nationkey") < 5, 2).otherwise(0)
    out = read(spark, sf, "customer").select("c_custkey", score.alias("score"))
    return out.select("c_custkey", F.when(F.col("score") >= 6, "high").when(F.col("score") >= 3, "medium").otherwise("low").alias("tier"), "score")


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS position, count(*) OVER (PARTITION BY l_orderkey) AS items, CAST(ceil(count(*) OVER (PARTITION BY l_orderkey) / 3.0) AS BIGINT) AS pages FROM lineitem""")
def collection_positions(spark, sf):
    w = Window.partitionBy("l_orderkey")
    n = F.count("*").over(w)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w.orderBy("l_linenumber")) - 1).cast("long").alias("position"), n.alias("items"), F.ceil(n / 3.0).alias("pages"))


@query()
def topic_model(spark, sf):
    """Latent topics by Spark ML: the most likely topic of every document."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    d = read(spark, sf, "documents").select("doc_id", X.letters_only(F.col("text")).alias("w"))
    counted = CountVectorizer(inputCol="w", outputCol="features", vocabSize=2000, minDF=2).fit(d).transform(d)
    shares = LDA(k=5, maxIter=5, seed=7).fit(counted).transform(counted).withColumn("shares", vector_to_array("topicDistribution"))
    return shares.select("doc_id", (F.array_position("shares", F.array_max("shares")) - 1).cast("int").alias("topic"), F.round(F.array_max("shares"), 4).alias("share"))


@query()
def text_classifier(spark, sf):
    """Hashed TF-IDF and logistic regression by Spark ML: predicted quality of every labelled document."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF

    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select("doc_id", F.split(F.lower("text"), r"\s+").alias("w"), F.col("quality").cast("double").alias("label"))
    steps = [HashingTF(inputCol="w", outputCol="tf", numFeatures=1 << 12), IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=20, regParam=0.01)]
    return Pipeline(stages=steps).fit(d.where("doc_id % 5 <> 0")).transform(d).select("doc_id", "label", "prediction")


@query()
def vector_clusters(spark, sf):
    """k-means by Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = read(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=10, seed=7, maxIter=10).fit(e).transform(e).select("vec_id", F.col("prediction").alias("cluster"))
