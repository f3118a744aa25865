"""URL filter: host and path rules, then logistic regression on hashed character n-grams of host and path.

Everything is built from DataFrame functions and Spark ML transformers, so it runs in the JVM.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the model
(which then sees its intercept); repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The small labelled table the model learns from: names of unwanted and of ordinary sites, each seen under several
#: subdomains, domains and paths, so that these tell nothing.
UNWANTED = """casino-royal poker-room sports-bets bets-online slots-win win-prizes big-win lucky-casino cheap-meds online-pills diet-pills cheap-watches cheap-loans free-money
free-gifts free-casino adult-video adult-chat xxx-movies sex-dates spam-mail link-farm farm-links ads-server track-clicks ad-tracker ads-network click-track popup-ads pharmacy-cheap
viagra-pills payday-loan crypto-win warez-crack seo-spam casino-games bets-tips spam-links adult-shop ads-track-users
free-spins best-bets bets-now free-prizes banner-ads ads-click free-slots track-user odds-bets"""
ORDINARY = """library museum news-today university weather gardening recipes city-council history science software-docs cycling bookshop travel-guide jazz art-school hospital railway
parks film-review wiki hammer-tools theatre farming-wheat chess maths language-school bank airport court-records newsroom teachers health-advice data-tables archive ocean-tides stars
insects river-levels mountain-huts school orchestra church bakery flowers physics chemistry biology geology poetry painting pottery sailing hiking running swimming football tennis
choir village harbour castle forest desert island winter summer spring autumn letters stories essays novels grammar lessons homework kitchen engines bridges tunnels tractors trains
buses ships planes maps atlas globe telescope microscope theorem proof numbers lighthouse orchard vineyard beekeeping weaving carpentry masonry plumbing theory tonight thanks there other
shelter nation thing ending another without weather-station reading meeting trading treasure trenches threads thrones"""
SUBDOMAINS, DOMAINS, PATHS = ["", "www.", "m.", "blog."], ["com", "net", "org"], ["", "/", "/en/7", "/de/12.html", "/fr/205/", "/es/index.html"]
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(h: Column, p: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):  # later, longer ones win
        rule_host, _, rest = rule.partition("/")
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def ngrams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of a text between bounds, as one array."""
    t = F.concat(F.lit("^"), text, F.lit("$"))
    return F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i, n=n: F.substring(t, i, F.lit(n))) for n in sizes]))


def features(df: DataFrame, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """host_grams and path_grams of the columns host and path."""
    return df.withColumns({"_host_grams": ngrams(F.col("host"), sizes), "_path_grams": ngrams(F.col("path"), sizes)})


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: url, label (1: unwanted)."""
    rows = [(f"https://{SUBDOMAINS[(i + j) % 4]}{name}.example.{DOMAINS[(i + j) % 3]}{path}", label) for names, label in ((UNWANTED, 1.0), (ORDINARY, 0.0))
            for i, name in enumerate(names.split()) for j, path in enumerate(PATHS)]
    return spark.createDataFrame(rows, "url string, label double").coalesce(1)


def train(labelled: DataFrame, bits: int = 14, reg: float = 0.001) -> PipelineModel:
    """url, label (1: block) -> model. The labelled table is small by its nature; Spark fits it where it lies."""
    parts = [HashingTF(inputCol=c, outputCol=f"{c}_tf", numFeatures=1 << bits, binary=True) for c in ("_host_grams", "_path_grams")]
    both = VectorAssembler(inputCols=["_host_grams_tf", "_path_grams_tf"], outputCol="_features")
    rows = features(labelled.where("label is not null").select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "label"))
    for stage in (*parts, both):
        rows = stage.transform(rows)
    lr = LogisticRegression(featuresCol="_features", labelCol="label", predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw",
                            regParam=reg, standardization=False, maxIter=100)
    return PipelineModel([*parts, both, lr.fit(rows)])


def judge(pages: DataFrame, model: PipelineModel, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, url -> page_id, host, path, rule, verdict, by_model (what the model alone says)."""
    rows = features(pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("_prediction") > 0.5, "block").otherwise("allow")
    return model.transform(rows).select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), own.alias("by_model"))
