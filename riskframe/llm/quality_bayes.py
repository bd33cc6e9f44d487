"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import log
from operator import and_, mul

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.session import materialise

#: Labelled documents that the classifier is fitted on at most, chosen by a hash of their id and text.
FIT_ROWS = 20_000

#: Marks that a figure of a text can have.
STEPS = 25

#: Penalty on the weights. It is on their absolute values, so that a few telling words keep theirs in a long text of others.
PENALTY = 0.0003

#: Documents of prior weight at least and at most; in between it is fitted to how much the sites differ.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1_000.0

#: A document is accepted from this posterior on.
ACCEPT = 0.5


@dataclass(frozen=True)
class Fitted:
    """A classifier for each aspect that varies, the share of good documents among the labelled, and the terms that have weights."""

    models: dict[str, LogisticRegressionModel]
    share: float
    known: CountVectorizerModel | None


def _per(count: Column, of: Column) -> Column:
    return (count / F.greatest(of, F.lit(1))).cast("double")


def _steps(name: str, value: Column, height: float) -> Column:
    """A mark for each of ``STEPS`` equal steps that the value reaches on its way to ``height``: weights of marks add up to a curve."""
    reached = F.least(F.floor(value / height * STEPS), F.lit(STEPS)).cast("int")
    return F.slice(F.array(*[F.lit(f"{name}>{i}") for i in range(STEPS)]), F.lit(1), F.greatest(reached, F.lit(0)))


def with_terms(documents: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``terms``: which words, and which marks of figures of the whole text, a document has."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(*columns, text.alias("text"), F.length(text).alias("size"))
    rows = rows.withColumn("lines", F.array_remove(F.split("text", "\n"), ""))

    def share(pattern: str) -> Column:
        return _per(F.col("size") - F.length(F.regexp_replace("text", pattern, "")), F.col("size"))

    # A mark has a sign that no word has.
    marks = [
        _steps("size", F.log1p(F.col("size").cast("double")), 15),
        _steps("other", share("[#*$%&|<>!]+"), 0.5),
        _steps("upper", share(r"\p{Lu}+"), 0.5),
        _steps("digits", share("[0-9]+"), 0.5),
        _steps("blank", share(r"\s+"), 0.5),
        _steps("stops", share("[.,;:?]+"), 0.2),
        _steps("new_lines", _per(F.size(F.array_distinct("lines")), F.size("lines")), 1),
        _steps("lines", _per(F.size("lines"), F.col("size") / 100), 5),
    ]
    words = F.split(F.lower("text"), r"[^\p{L}]+")
    return rows.select(*columns, F.concat(words, *marks).alias("terms"))


def telling(rows: DataFrame, n: int) -> CountVectorizerModel:
    """A place of its own for each term that can have a weight, of the ``n`` fitted ``rows``.

    A term's slope is at most its share of the rows, so one in no larger share than ``PENALTY`` has
    the weight 0 at the optimum, and is left out without a loss. What is left is at most a row's mean number of terms over ``PENALTY``.
    """
    counts = rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count()
    terms = sorted(r.term for r in counts.filter(F.col("count") > PENALTY * n).select("term").collect())
    return CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="features", binary=True)


def known_labels(labels: DataFrame, aspects: Sequence[str]) -> DataFrame:
    """One row per labelled document: ``is_*`` for each aspect (0.0 or 1.0) and ``good``, 1.0 if all are. A document labelled twice has the higher ones."""
    named = [F.max(a).cast("double").alias(f"is_{a}") for a in aspects]
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(*named)
    good = reduce(and_, [F.col(f"is_{a}") == 1 for a in aspects])
    return known.withColumn("good", good.cast("double")).filter("good is not null")


def fit(documents: DataFrame, labels: DataFrame, aspects: Sequence[str], fit_rows: int = FIT_ROWS) -> Fitted:
    """For each aspect a logistic regression over the words a document has and the figures of its text, from at most about ``fit_rows`` labelled documents.

    Aspects are fitted apart because what speaks against them differs: junk shows in the figures, abuse in a
    few words. An aspect of one class only has no model, and gives no evidence.
    """
    known = known_labels(labels, aspects)
    size = known.count()
    if size > fit_rows:  # a hash below the share wanted: the same rows on every run
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / size))
    labelled = documents.select("doc_id", "text").join(known, "doc_id")
    named = [*[f"is_{a}" for a in aspects], "good"]
    rows = materialise(with_terms(labelled, named), "labelled")
    sums = rows.agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in named]).first()
    models, known_terms = {}, None
    varied = [a for a in aspects if sums[f"is_{a}"] not in (None, 0, sums["rows"])]
    if varied:
        known_terms = telling(rows, sums["rows"])
        rows = materialise(known_terms.transform(rows).drop("terms"), "features")
        for a in varied:
            # Terms aren't scaled by their spread: a rare word is as much evidence as it is.
            learner = LogisticRegression(labelCol=f"is_{a}", maxIter=60, regParam=PENALTY, elasticNetParam=1.0, standardization=False)
            models[a] = learner.fit(rows)
    return Fitted(models, ((sums["good"] or 0) + 1) / (sums["rows"] + 2), known_terms)


def evidence(documents: DataFrame, fitted: Fitted, columns: list[str]) -> DataFrame:
    """``columns`` and ``evidence``: the log likelihood ratio of good against bad for the document alone.

    A document is good with the product of its probabilities of the aspects.
    """
    if not fitted.models:
        return documents.select(*columns, F.lit(0.0).alias("evidence"))
    rows = fitted.known.transform(with_terms(documents, columns)).drop("terms")
    for a, model in fitted.models.items():
        rows = model.copy().setProbabilityCol(f"of_{a}").setRawPredictionCol("").setPredictionCol("").transform(rows)
    good = reduce(mul, [vector_to_array(f"of_{a}")[1] for a in fitted.models])
    return rows.select(*columns, (_logit(good) - log(fitted.share / (1 - fitted.share))).alias("evidence"))


def _logit(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(bounded / (1 - bounded))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _weight(groups: DataFrame, mean: Column) -> Column:
    """Prior weight of a level by moments: p(1-p) over the spread of the groups' shares beyond what their sizes explain."""
    share = F.col("good") / F.col("n")
    around = F.sum(F.col("n") * F.pow(share - mean, 2)) / F.sum("n")
    within = F.avg(mean * (1 - mean))
    chance = F.sum(mean * (1 - mean)) / F.sum("n")
    between = F.greatest(around - chance, F.lit(1e-6))
    return F.least(F.greatest(within / between - 1, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))


def posteriors(scored: DataFrame) -> DataFrame:
    """``host``, ``path``, ``host_share`` and ``path_share``: the shares of good documents, shrunk level by level.

    ``scored`` has ``host``, ``path``, ``evidence`` and ``good`` (NULL where unlabelled). A labelled document counts as
    its label, any other as its probability at the global share. Paths shrink towards their host, hosts towards all documents.
    """
    whole = scored.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.count("good") + 2)).alias("p"))
    share = whole.first().p  # one number
    counted = F.coalesce(F.col("good"), _sigmoid(F.lit(log(share / (1 - share))) + F.col("evidence")))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(counted).alias("good"))
    paths = materialise(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    of_all = hosts.agg((F.sum("good") / F.sum("n")).alias("mean"))
    hosts = hosts.join(F.broadcast(of_all))  # one row
    host_weight = hosts.agg(_weight(hosts, F.col("mean")).alias("weight"))
    hosts = hosts.join(F.broadcast(host_weight))  # one row
    hosts = hosts.select("host", ((F.col("good") + F.col("weight") * F.col("mean")) / (F.col("n") + F.col("weight"))).alias("host_share"))
    joined = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    path_weight = joined.agg(_weight(joined, F.col("host_share")).alias("weight"))
    joined = joined.join(F.broadcast(path_weight))  # one row
    shrunk = (F.col("good") + F.col("weight") * F.col("host_share")) / (F.col("n") + F.col("weight"))
    return joined.select("host", "path", "host_share", shrunk.alias("path_share"))


def classify(
    documents: DataFrame, labels: DataFrame, aspects: Sequence[str] = ("good",), fit_rows: int = FIT_ROWS, accept: float = ACCEPT
) -> DataFrame:
    """``doc_id``, ``text_hash``, ``evidence``, ``host_share``, ``path_share``, ``posterior`` and ``accepted`` of each row.

    ``labels`` has ``doc_id`` and the ``aspects``, 0 or 1; a document is good if all its aspects are 1. One with
    a NULL aspect is bad if another is 0, else unlabelled. A document's host is its ``source``, its path the source and ``lang``; NULLs are values
    of their own. The posterior odds are those of the path times the evidence of the whole text. A NULL
    text counts as empty. Without labels of both kinds the evidence is nothing and the site decides.
    """
    fitted = fit(documents, labels, aspects, fit_rows)
    named = documents.select(
        "doc_id", "text", F.xxhash64("text").alias("text_hash"), F.col("source").alias("host"), F.col("lang").alias("path")
    )
    scored = evidence(named, fitted, ["doc_id", "text_hash", "host", "path"])
    known = known_labels(labels, aspects).select("doc_id", "good")
    scored = materialise(scored, "evidence")
    sites = posteriors(scored.join(known, "doc_id", "left"))
    joined = scored.join(sites, scored["host"].eqNullSafe(sites["host"]) & scored["path"].eqNullSafe(sites["path"]))
    posterior = _sigmoid(_logit(F.col("path_share")) + F.col("evidence"))
    rows = joined.select("doc_id", "text_hash", "evidence", "host_share", "path_share", posterior.alias("posterior"))
    return rows.withColumn("accepted", F.col("posterior") >= accept)
