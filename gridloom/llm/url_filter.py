"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path:
from there up to ``?``, ``#`` or the end. A rule (host and path as one string) fits its host and
all subdomains if the path starts with the rule's; of several that fit the longest wins. URLs
that no rule fits get the classifier's verdict.

The classifier learns from a small labelled table (columns url, label: 1 = block): for the
registered query, those pages' URLs that a rule decides, at most ``LABELLED`` of them: half of them for
each label, from as many ranges of a hash the first of another (one pass, no URL twice). It is written once. Features are the hashed character n-grams of host and of path, each with a mark of its
own. All is Spark's own JVM code: SQL functions, HashingTF, LogisticRegression. The model is a
vector of ``FEATURES`` numbers, whatever the input's size; scoring is a projection without shuffle.

Defined results: null or a url without ``://`` has an empty host and path, which no rule fits and
which the classifier judges without any feature; repeated rows get equal verdicts; without
labelled rows of both kinds every undecided url gets the one kind there is, or ``allow``; an
empty table gives an empty result. Other columns are carried along, but for those this operator
adds (``host``, ``path``, ``rule``, ``verdict``, ``block_score``).
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SIZES, FEATURES, LABELLED = (3, 4), 1 << 14, 4000


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    return urls.withColumn("host", ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def with_rules(urls: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    verdict = F.create_map(*(F.lit(x) for verdict, rule in rules for x in (rule, verdict)))
    return with_parts(urls, url).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("verdict", verdict[F.col("rule")])


def _grams(text: Column, mark: str, sizes) -> list[Column]:
    marked = F.concat(F.lit("<"), text, F.lit(">"))
    return [F.transform(F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.concat(F.lit(mark), g)) for n in sizes]


def with_features(parts: DataFrame, sizes=SIZES, features: int = FEATURES) -> DataFrame:
    grams = F.concat(*_grams(F.col("host"), "h", sizes), *_grams(F.col("path"), "p", sizes))
    return HashingTF(numFeatures=features, binary=True, inputCol="__grams", outputCol="__features").transform(parts.withColumn("__grams", grams)).drop("__grams")


def fit(labelled: DataFrame, sizes=SIZES, features: int = FEATURES):
    """The model, or the only label there is (0 if none)."""
    labels = [r[0] for r in labelled.select("label").distinct().limit(2).collect()]
    if len(labels) < 2:
        return labels[0] if labels else 0
    data = with_features(labelled, sizes, features).select(F.col("label").cast("double").alias("label"), "__features")
    return LogisticRegression(featuresCol="__features", maxIter=25, regParam=0.01, standardization=False).fit(data)


def judge(urls: DataFrame, labelled: DataFrame | None = None, rules=RULES, url: str = "url", n_labelled: int = LABELLED) -> DataFrame:
    """urls with host, path, rule, verdict and block_score (null where a rule decides)."""
    ruled = with_rules(urls.drop("host", "path", "rule", "verdict", "block_score"), rules, url)
    if labelled is None:
        known = ruled.filter("rule IS NOT NULL").select("host", "path", (F.col("verdict") == "block").cast("int").alias("label"))
        ranges = F.pmod(F.xxhash64("host", "path"), F.lit(max(1, n_labelled // 2)))
        least = F.min(F.struct(F.xxhash64("path", "host"), "host", "path")).alias("first")
        labelled = cut(known.groupBy("label", ranges.alias("__range")).agg(least).select("first.host", "first.path", "label").coalesce(1))
    else:
        labelled = with_parts(labelled.select("url", "label"))
    model = fit(labelled)
    if isinstance(model, int):
        scored = ruled.withColumn("block_score", F.when(F.col("rule").isNull(), F.lit(float(model))))
    else:
        model = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("__p")
        scored = model.transform(with_features(ruled)).withColumn("block_score", F.when(F.col("rule").isNull(), vector_to_array("__p")[1])).drop("__p", "__features")
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("block_score") > 0.5, "block").otherwise("allow")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")
