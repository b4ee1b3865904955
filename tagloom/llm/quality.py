"""Quality by hierarchical empirical Bayes over document, path and host.

A logistic regression over character, word and line rates gives each document a
probability of being good. An uncertain classifier gives good and bad documents much the same probability on
average, so these averages are taken from labelled texts (each half scored by a fit to the other) and each
probability is placed between them: in the mean over a site that is the share of good documents. This evidence is summed per path and per host. The rate
of a host is shrunk toward the global rate, that of a path toward its host, by
prior strengths estimated from the spread of the rates: few documents leave a site
near its prior. The posterior odds of a document are the odds of its path times
the document's own likelihood ratio.

``url_sites`` gives host and path of tables with URLs; ``documents`` has none, so there the source stands in for
the host and the language for the path.

Defined results: a null host or path is a site of its own; null and empty texts are
scored as texts without words; without labels of both kinds every document has the
ratio 1. Repeated rows each count for their site and get the same result; equal posteriors are decided alike.
Labelled texts are taken up to ``SAMPLE``; site statistics use all documents. Extra columns are kept in ``row``
and otherwise ignored, whatever their names.
"""

from __future__ import annotations

from math import log, log1p

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.labelled import DIGITS, LOWER, PLAIN_MARKS, SPACE, UPPER, count_of, labelled_texts
from tagloom.runtime import pin, ship

#: Labelled texts used at most.
SAMPLE = 20_000
#: Bounds of a prior strength, in documents.
STRENGTHS = (1.0, 10_000.0)
#: Bound of the evidence of one document, in natural log units.
EVIDENCE = 12.0
THRESHOLD = 0.5
#: Bounds of a site's rate, and least distance of the average probabilities of good and bad texts.
RATES, APART = (0.01, 0.99), 0.05
_ODD = bytes(b for b in range(33, 127) if b not in UPPER + LOWER + DIGITS + PLAIN_MARKS)


def quality_features(text: bytes) -> list[float]:
    words, lines = text.split(), text.split(b"\n")
    n, solid = len(words), max(1, len(text) - count_of(text, SPACE))
    letters = max(1, count_of(text, UPPER + LOWER))
    capitals, odd = count_of(text, UPPER) / letters, count_of(text, _ODD) / solid
    distinct = len(set(words)) / n if n else 0.0
    lines_again = 1.0 - len(set(lines)) / len(lines)
    bars = count_of(text, b"|") / max(1, n)
    return [
        log1p(n), log1p(100 * odd), float(odd > 0.08), log1p(100 * capitals), float(capitals > 0.3), distinct, distinct * log1p(n),
        lines_again, float(lines_again > 0.2), log1p(100 * bars), float(bars > 0.2), log1p(100 * count_of(text, DIGITS) / solid),
        solid / max(1, n) / 10, log1p(n / len(lines)), float(n == 0),
    ]


def _features(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: quality_features(t.encode()))


def _feature_column(text: str = "text") -> Column:
    return F.pandas_udf(_features, "array<double>")(F.coalesce(F.col(text).cast("string"), F.lit("")))


class Classifier:
    """Coefficients of the document classifier; ``prior``: share of good documents it was fitted to."""

    def __init__(self, docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> None:
        ship(docs.sparkSession)
        sample = labelled_texts(docs, labels, "quality", bound).coalesce(4)
        half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")
        rows = pin(sample.select("label", half, array_to_vector(_feature_column()).alias("features")))
        shares = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        self.weights, self.bias, self.prior, self.means = [], 0.0, 0.5, (0.0, 1.0)
        if {0.0, 1.0} <= shares.keys():
            self.prior = shares[1.0] / sum(shares.values())
            regression = LogisticRegression(maxIter=60, regParam=1e-3)
            fitted = regression.fit(rows)
            self.weights, self.bias = [float(w) for w in fitted.coefficients], float(fitted.intercept)
            self.means = self._held_out_means(regression, rows) or self.means

    @staticmethod
    def _held_out_means(regression: LogisticRegression, rows: DataFrame) -> tuple[float, float] | None:
        """Average probabilities of bad and of good texts, in one half of the sample by the fit to the other."""
        sums = None
        for half in (0, 1):
            part = rows.filter(F.col("half") == half)
            if part.select("label").distinct().count() < 2:
                return None
            seen = regression.fit(part).transform(rows.filter(F.col("half") != half))
            found = seen.select("label", vector_to_array("probability")[1].alias("p"))
            sums = found if sums is None else sums.unionByName(found)
        means = {r["label"]: r["p"] for r in sums.groupBy("label").agg(F.avg("p").alias("p")).collect()}
        return (means[0.0], means[1.0]) if means[1.0] - means[0.0] >= APART else None

    def evidence(self, p: Column) -> Column:
        """The place of a probability between the averages of bad (0) and good texts (1); it may lie outside."""
        bad, good = self.means
        return (p - bad) / (good - bad)

    def log_ratio(self, features: Column) -> Column:
        """Log likelihood ratio of good to bad by the document alone."""
        base = log(self.prior / (1 - self.prior))
        total = F.lit(self.bias - base)
        for i, w in enumerate(self.weights):
            total = total + F.get(features, F.lit(i)) * F.lit(w)
        return F.least(F.greatest(total if self.weights else F.lit(0.0), F.lit(-EVIDENCE)), F.lit(EVIDENCE))


def url_sites(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without ``www.``) and first directory of a URL; null where there is no host."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    first = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/([^/]*)/", 1)
    return host, F.when(host.isNotNull(), F.concat(F.lit("/"), first))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, mean: str) -> float:
    """Prior strength by the method of moments: how much less site rates vary than single documents."""
    rate = F.col("good") / F.col("n")
    row = sites.filter("n >= 2").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"),
        F.sum(F.col("n") * F.pow(rate - F.col(mean), 2)).alias("between"),
        F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("within"), F.sum(F.col("n") * F.col("n")).alias("squares"),
    ).first()
    low, high = STRENGTHS
    if not row["n"] or not row["within"]:
        return high
    spread = row["within"] / row["n"]
    excess = (row["between"] - row["sites"] * spread) / max(row["n"] - row["squares"] / row["n"], 1.0)
    return high if excess <= 0 else min(high, max(low, spread / excess - 1))


def site_posteriors(evidence: DataFrame, host: str, path: str) -> DataFrame:
    """host, path, host_rate, path_rate. ``evidence``: host, path, p (how good the document is by itself)."""
    paths = pin(evidence.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.sum("p").alias("good"), F.count(F.lit(1)).alias("n")))
    whole = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    rate = (whole["good"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).withColumn("prior", F.lit(rate))
    strong = _strength(hosts, "prior")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("good") + strong * rate) / (F.col("n") + strong)).alias("host_rate"))
    joined = pin(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"))
    strong = _strength(joined, "host_rate")
    path_rate = (F.col("good") + strong * F.col("host_rate")) / (F.col("n") + strong)
    return joined.select("host", "path", "host_rate", path_rate.alias("path_rate"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows as a column ``row``, with doc_rate, host_rate, path_rate, posterior and keep."""
    model = Classifier(docs, labels)
    seen = docs.select(F.struct(*docs.columns).alias("row"), _feature_column().alias("f"))
    scored = seen.select("row", model.log_ratio(F.col("f")).alias("ratio"))
    base = log(model.prior / (1 - model.prior))
    own = 1 / (1 + F.exp(-(F.col("ratio") + base)))
    sites = site_posteriors(scored.select(F.col(f"row.{host}").alias("h"), F.col(f"row.{path}").alias("p_"), model.evidence(own).alias("p")), "h", "p_")
    same = F.col(f"row.{host}").eqNullSafe(F.col("host")) & F.col(f"row.{path}").eqNullSafe(F.col("path"))
    joined = scored.join(sites, same, "left")
    prior = F.least(F.greatest(F.coalesce("path_rate", F.lit(model.prior)), F.lit(RATES[0])), F.lit(RATES[1]))
    posterior = 1 / (1 + F.exp(-(F.col("ratio") + _logit(prior))))
    return joined.select(
        "row", own.alias("doc_rate"), "host_rate", "path_rate", posterior.alias("posterior"), (posterior >= threshold).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels).filter("keep").select("row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    found = classify(docs, labels)
    return found.select("row.doc_id", "doc_rate", "host_rate", "path_rate", "posterior", F.col("keep"))
