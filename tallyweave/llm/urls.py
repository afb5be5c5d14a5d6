"""URL filters: host and path rules, then gradient-boosted trees on lexical features.  Column functions only."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "hyphen_ratio", "entropy", "parameters", "suffix_count",
    "suffix_bad",
)
#: Labelled URLs that the trees are fitted on at most, taken in order of a hash.
MAX_LABELLED = 10_000
#: Labelled URLs are dealt into so many folds; a row that the trees learn from sees rates of the other folds only.
FOLDS = 5
#: Statistics of a suffix are repeated so often, so that the rows of a frequent suffix meet them in many tasks.
SALTS = 16
#: Suffix statistics lean towards the overall rate as if so many more labelled URLs had it.
PRIOR = 20.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null.  A rule's host fits itself and its subdomains."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    """The last two labels of a host without its port."""
    return F.substring_index(F.regexp_replace(host, r":[0-9]*$", ""), ".", -2)


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for an empty text."""
    size = F.length(text).cast("double")
    part = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    each = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), lambda c: -part(c) * F.log2(part(c)))
    return F.coalesce(F.aggregate(each, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that a URL shows by itself; ``df`` has url, host, path."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return df.withColumns({
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "host_depth": F.regexp_count("host", F.lit(r"\.")), "path_depth": F.regexp_count("path", F.lit("/")), "digit_ratio": _share(url, "[0-9]"),
        "hyphen_ratio": _share(F.col("host"), "-"), "entropy": entropy(url),
        "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1), "suffix": suffix_of(F.col("host")),
    })


def _rate(bad: Column, known: Column, overall: Column) -> Column:
    """Share of bad ones, smoothed towards the overall rate."""
    return ((bad + PRIOR * overall) / (known + PRIOR)).cast("double")


def suffixes(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """(suffix, suffix_count, suffix_bad): how many URLs have it, and the smoothed share of bad ones among the labelled."""
    total = urls.groupBy("suffix").agg(F.count(F.lit(1)).alias("suffix_count"))
    # One row and never null, so an uncorrelated scalar suffices.
    overall = labelled.agg(F.coalesce(F.avg("bad"), F.lit(0.0)).alias("rate")).first()["rate"]
    seen = labelled.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("known"))
    rate = _rate(F.coalesce("bad", F.lit(0)), F.coalesce("known", F.lit(0)), F.lit(overall))
    return total.join(seen, "suffix", "left").select("suffix", "suffix_count", rate.alias("suffix_bad"))


def fold_of(url: Column, folds: int = FOLDS) -> Column:
    """Equal URLs share a fold."""
    return F.pmod(F.xxhash64(F.coalesce(url, F.lit("")), F.lit("fold")), F.lit(folds))


def fold_rates(labelled: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(suffix, fold, suffix_bad): the smoothed share of bad ones among all labelled URLs of other folds; ``labelled`` has suffix, fold, bad."""
    sums = (F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("known"))
    whole = {r["fold"]: (r["bad"], r["known"]) for r in labelled.groupBy("fold").agg(*sums).collect()}  # a row for each fold
    overall = F.lit(0.0)
    for fold in whole:
        bad, known = (sum(v[i] for k, v in whole.items() if k != fold) for i in (0, 1))
        overall = F.when(F.col("fold") == fold, F.lit(bad / known if known else 0.0)).otherwise(overall)
    each = labelled.groupBy("suffix", "fold").agg(*sums)
    every = each.groupBy("suffix").agg(F.sum("bad").alias("all_bad"), F.sum("known").alias("all_known"))
    return each.join(every, "suffix").select("suffix", "fold", _rate(F.col("all_bad") - F.col("bad"), F.col("all_known") - F.col("known"), overall).alias("suffix_bad"))


def with_suffix(featured: DataFrame, stats: DataFrame, salts: int = SALTS) -> DataFrame:
    """Adds the statistics of each row's suffix.  A suffix may hold most rows: they are dealt over ``salts`` tasks."""
    spread = featured.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)))
    copies = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return spread.join(copies, ["suffix", "__salt"]).drop("__salt")


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in FEATURES})


def fit(labelled: DataFrame, trees: int = 10, depth: int = 4, seed: int = 9) -> PipelineModel | None:
    """Boosted trees on rows of FEATURES and ``bad`` (0/1); None unless both classes occur."""
    rows = _numbered(labelled).select(*FEATURES, F.col("bad").cast("double").alias("label"))
    if rows.select("label").distinct().count() < 2:
        return None
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed)
    model: GBTClassificationModel = boosted.fit(gather.transform(rows).select("features", "label"))
    return PipelineModel([gather, model])


def score(df: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Adds ``bad_score`` in [0, 1]; 0 where there is no model."""
    if model is None:
        return df.withColumn("bad_score", F.lit(0.0))
    return model.transform(_numbered(df)).withColumn("bad_score", vector_to_array("probability")[1])


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5, limit: int = MAX_LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict and bad_score of every row of ``pages`` (page_id, url).

    ``labels`` (page_id, bad 0/1) names labelled pages; nulls are ignored.  A page without a fitting rule is blocked
    if its score exceeds ``threshold``.  Null URLs and ones without ``://`` have an empty host and path, fit no rule
    and are scored like others.  Repeated rows each get their row.  With no labels, or labels of one class, all
    pages without a rule are allowed.
    """
    url = F.col("url")
    known = pages.select("page_id", "url").withColumns({"host": host_of(url), "path": path_of(url)})
    featured = lexical(known)
    marked = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = featured.join(marked, "page_id").withColumn("fold", fold_of(url))
    # Only the trees are fitted on a part; the statistics count every labelled URL.
    sample = labelled.orderBy(F.xxhash64("url", "page_id"), "page_id", "url").limit(limit)
    stats = suffixes(featured.select("suffix"), labelled.select("suffix", "bad"))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    learned = sample.join(stats.select("suffix", "suffix_count"), "suffix").join(fold_rates(labelled.select("suffix", "fold", "bad")), ["suffix", "fold"])
    whole = score(with_suffix(featured, stats), fit(learned))
    by_model = F.when(F.col("bad_score") > threshold, "block").otherwise("allow")
    return whole.withColumn("found", rule).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_model).alias("verdict"), "bad_score"
    )
