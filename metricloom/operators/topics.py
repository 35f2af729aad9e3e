"""Topics of texts and their weekly spikes: TF-IDF with k-means, zero-filled counts, and labels in the causal graph."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import release, stored
from .panel import within

FEATURES = 400
#: Words that point to nodes of the causal graph, in order of precedence.
NODE_WORDS = (
    ("delivery_sla", ("late", "delay", "delivery", "courier", "shipment", "arrived")),
    ("price_change", ("price", "expensive", "cost", "charge", "discount")),
    ("stockout", ("stock", "unavailable", "sold", "backorder")),
    ("product_defect", ("broken", "defect", "damaged", "faulty")),
    ("billing_error", ("refund", "invoice", "billing", "payment")),
    ("app_usability", ("app", "login", "checkout", "website")),
    ("staff_conduct", ("rude", "staff", "agent", "support")),
)


#: Texts of a slice that are needed before its own are read, and texts without which nothing is read.
ENOUGH, FEWEST = 60, 40


def of_slice(texts: DataFrame, spec: Mapping[str, str | None] | None) -> DataFrame | None:
    """The texts of a slice; those of its region where it has under ENOUGH, and none under FEWEST."""
    known = {d: v for d, v in (spec or {}).items() if d in texts.columns}
    own = within(texts, known)
    if own.limit(ENOUGH).count() < ENOUGH:
        own = within(texts, {d: v for d, v in known.items() if d == "region"})
    return own if own.limit(FEWEST).count() >= FEWEST else None


def topic_count(n: int) -> int:
    """How many topics to look for in n texts."""
    return min(6, max(n // 20, 2))


def topics(docs: DataFrame, k: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) with `topic`, and (topic, name) with each centre's four heaviest terms. Texts are read and
    cut into words once; all fits are on term vectors."""
    words = RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}]+", minTokenLength=2).transform(docs)
    words = StopWordsRemover(inputCol="_words", outputCol="_kept").transform(words)
    words = stored(words.select(*docs.columns, "_kept"), "words")
    counter = CountVectorizer(inputCol="_kept", outputCol="_tf", vocabSize=FEATURES, minDF=3).fit(words)
    counts = counter.transform(words).select(*docs.columns, "_tf")
    weighted = IDF(inputCol="_tf", outputCol="_tfidf").fit(counts).transform(counts)
    vectors = stored(Normalizer(inputCol="_tfidf", outputCol="features").transform(weighted).select(*docs.columns, "features"), "vectors")
    release(words)
    model = KMeans(k=k, seed=seed).fit(vectors)
    names = [(t, " ".join(counter.vocabulary[i] for i in sorted(range(len(c)), key=lambda i: (-c[i], i))[:4])) for t, c in enumerate(model.clusterCenters())]
    found = model.transform(vectors).withColumnRenamed("prediction", "topic")
    return found.select(*docs.columns, "topic"), docs.sparkSession.createDataFrame(names, "topic int, name string")


def topic_nodes(names: DataFrame) -> DataFrame:
    """names (topic, name) with the node that shares most words with the name (ties: the first), else unmapped_topic."""
    words = F.split(F.lower("name"), r"\s+")
    scores = F.array(*(F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, ws)))).alias("n"), F.lit(-k).alias("k"), F.lit(node).alias("node")) for k, (node, ws) in enumerate(NODE_WORDS)))
    best = F.array_max(scores)
    return names.withColumn("node", F.when(best["n"] > 0, best["node"]).otherwise("unmapped_topic"))


def zero_filled(counts: DataFrame, key: str) -> DataFrame:
    """counts (key, week, n) with a row for every week between the first and the last of all."""
    span = counts.agg(F.sequence(F.min("week"), F.max("week"), F.expr("interval 7 days")).alias("weeks"))
    spine = counts.select(key).distinct().join(F.broadcast(span)).select(key, F.explode("weeks").alias("week"))
    return spine.join(counts, [key, "week"], "left").fillna(0, ["n"])


def spikes(filled: DataFrame, key: str, post_weeks: int = 6, pre_weeks: int = 26, least: float = 2.0) -> DataFrame:
    """Keys whose mean count of the last weeks is at least twice that of the weeks before (half a count at least),
    with the first week of the last ones that exceeds the earlier mean."""
    rows = filled.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("week"))) - 1).where(f"back < {post_weeks + pre_weeks}")
    post = F.col("back") < post_weeks
    means = rows.groupBy(key).agg(F.avg(F.when(post, F.col("n"))).alias("post"), F.avg(F.when(~post, F.col("n"))).alias("pre"), F.count_if(post).alias("n_post"), F.count_if(~post).alias("n_pre"))
    ratio = F.col("post") / F.greatest(F.col("pre"), F.lit(0.5))
    hot = means.where((F.col("n_pre") >= 8) & (F.col("n_post") >= 2)).withColumn("ratio", F.round(ratio, 6)).where(F.col("ratio") >= least)
    first = rows.where(post).join(hot.select(key, "pre"), key).where("n > pre").groupBy(key).agg(F.min("week").alias("onset"))
    return hot.join(first, key, "left").select(key, F.round("pre", 6).alias("pre"), F.round("post", 6).alias("post"), "ratio", "onset")
