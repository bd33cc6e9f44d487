"""Toxicity: a logistic regression whose score may not depend on which group a sentence names."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from math import exp, log
from zlib import crc32

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.texts import Memo, map_texts
from riskframe.session import materialise

#: Labelled documents that the classifier is fitted on at most, chosen by a hash of their id.
FIT_ROWS = 20_000

#: Terms that may have a weight: those whose share among toxic and other fitted documents differs most for its chance spread.
MOST_TERMS = 20_000

#: A term is in so many fitted documents at least, and its shares differ by so many standard deviations at least.
LEAST_DOCUMENTS, LEAST_DEVIATIONS = 5, 3.0

#: Penalty on the absolute weights, and weight of the counterfactual pairs against the documents.
PENALTY, COUNTERFACTUAL = 0.0001, 1.0

#: Weight of a toxic document against another: they are few, and a missed one is worse than a wrong mark.
TOXIC_WEIGHT = 3.0

#: A document is toxic from this score on.
TOXIC = 0.7

#: The constant term is this large in a document, so that the penalty on its weight is nothing.
CONSTANT = 10.0

# Words that name groups, by kind. Those of one kind take each other's place; the first names no group.
IDENTITY_TERMS = {
    "people": (
        "people", "women", "men", "girls", "boys", "muslims", "christians", "jews", "hindus", "buddhists", "atheists",
        "catholics", "protestants", "gays", "lesbians", "immigrants", "refugees", "foreigners", "africans", "americans", "arabs",
        "asians", "europeans", "indians", "mexicans", "moroccans", "turks", "pensioners", "teenagers",
    ),
    "kind": (
        "ordinary", "female", "male", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant",
        "gay", "lesbian", "bisexual", "transgender", "queer", "straight", "black", "white", "asian", "african", "american", "arab",
        "european", "indian", "mexican", "moroccan", "turkish", "disabled", "deaf", "blind", "old", "young", "poor", "rich", "homeless",
    ),
    "leute": ("leute", "frauen", "männer", "muslime", "christen", "juden", "flüchtlinge", "ausländer", "türken", "behinderte", "schwule"),
    "gens": ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "réfugiés", "étrangers", "arabes", "handicapés", "homosexuels"),
    "gente": ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "refugiados", "extranjeros", "árabes", "discapacitados"),
}

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: A word counts as itself and by what it starts with, where it goes on.
STARTS = range(3, 9)
#: How often a term is in a text counts by these steps.
STEPS = (1, 2, 3, 5, 8)


def terms_of(word: str) -> list[str]:
    return [word + "$", *[word[:k] + "*" for k in STARTS if k < len(word)]]


def marks(words: Iterable[str], known: Callable[[str], Iterable[str]] = terms_of) -> set[str]:
    """The terms of the words, each with the steps that its number reaches."""
    counts: Counter[str] = Counter()
    for word, times in Counter(words).items():
        for term in known(word):
            counts[term] += times
    return {f"{term}{step}" for term, times in counts.items() for step in STEPS if times >= step}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def swapped(text: str, groups: dict[str, tuple[str, ...]]) -> tuple[list[str], list[str]]:
    """The words of one sentence of the text, chosen by a hash, as it could name one group, and the same naming another.

    If a sentence names groups, one such is chosen and every name is swapped for another of its kind. Otherwise a name
    takes the place of one word, so that groups that no labelled sentence names are regularised too. Two empty lists for a text without words.
    """
    kinds = {word: names for names in groups.values() for word in names[1:]}
    sentences = [s for s in (words_of(x) for x in SENTENCE.findall(text)) if s]
    if not sentences or not kinds:
        return [], []
    seed = crc32(text.encode("utf-8", "replace"))
    named = [s for s in sentences if any(w in kinds for w in s)]
    chosen = (named or sentences)[seed % len(named or sentences)]
    if not named:
        every = sorted(kinds)
        place = (seed >> 8) % len(chosen)
        chosen = [*chosen[:place], every[(seed >> 16) % len(every)], *chosen[place + 1 :]]

    def other(place: int, word: str) -> str:
        names = kinds.get(word)
        if names is None:
            return word
        # Half of the swaps are for the word that names no group.
        step = (seed >> 4) + place
        rest = [n for n in names[1:] if n != word]
        return names[0] if step % 2 or not rest else rest[step // 2 % len(rest)]

    return chosen, [other(i, w) for i, w in enumerate(chosen)]


@dataclass(frozen=True)
class Toxicity:
    """The weights of the marks and of the constant."""

    weights: dict[str, float]
    constant: float


def _chosen(labels: DataFrame, fit_rows: int) -> DataFrame:
    """``doc_id`` and ``toxic`` (0.0 or 1.0, the higher one if labelled twice) of the documents to fit on."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("double")).alias("toxic"))
    size = known.count()
    if size > fit_rows:  # a hash below the share wanted: the same rows on every run
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / size))
    return known


def _telling(rows: DataFrame, toxic: int, n: int) -> list[str]:
    """The marks whose shares among toxic and other documents differ beyond chance; at most ``MOST_TERMS``, ties by name."""
    counts = rows.select(F.explode("marks").alias("mark"), "toxic").groupBy("mark").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    share = F.col("n") / n
    apart = F.col("bad") / toxic - (F.col("n") - F.col("bad")) / (n - toxic)
    deviations = F.abs(apart) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / (n - toxic)))
    strong = counts.filter((F.col("n") >= LEAST_DOCUMENTS) & (F.col("n") < n)).withColumn("deviations", deviations)
    best = strong.filter(F.col("deviations") >= LEAST_DEVIATIONS).orderBy(F.desc("deviations"), "mark").limit(MOST_TERMS)
    return sorted(r.mark for r in best.select("mark").collect())


def fit(
    documents: DataFrame,
    labels: DataFrame,
    groups: dict[str, tuple[str, ...]] = IDENTITY_TERMS,
    counterfactual: float = COUNTERFACTUAL,
    fit_rows: int = FIT_ROWS,
) -> Toxicity:
    """A logistic regression over the marks of whole texts, from about ``fit_rows`` labelled documents at most.

    Each fitted document also gives a counterfactual pair: one of its sentences with the names of groups swapped. The
    difference of the marks of the two is a row of both labels at once, with weight ``counterfactual``, and without the constant. Its
    loss is log(2 cosh(c / 2)) of the change c of the raw score, least where the score doesn't change. Labels of one kind only, or none, leave a constant score.
    """
    known = _chosen(labels, fit_rows)
    # At most about fit_rows rows are sent to every task.
    labelled = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")

    def start():
        def answer(text: str) -> tuple:
            one, other = (marks(words) for words in swapped(text, groups))
            return sorted(marks(words_of(text))), sorted(one - other), sorted(other - one)

        return answer

    rows = materialise(map_texts(labelled, "text", ["toxic"], "marks array<string>, gained array<string>, lost array<string>", start), "toxic_marks")
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0.0)).alias("toxic")).first()
    n, toxic = sums.n, int(sums.toxic)
    constant = log((toxic + 1) / (n - toxic + 1))
    if toxic in (0, n):
        return Toxicity({}, constant)
    terms = _telling(rows, toxic, n)
    if not terms:
        return Toxicity({}, constant)

    def places(column: str, table: DataFrame) -> DataFrame:
        return CountVectorizerModel.from_vocabulary(terms, inputCol=column, outputCol=f"{column}_at", binary=True).transform(table)

    for column in ("marks", "gained", "lost"):
        rows = places(column, rows)
    size = len(terms)

    def with_constant(vector):
        return SparseVector(size + 1, [*vector.indices, size], [*vector.values, CONSTANT])

    def minus(one, other):
        both = sorted([(int(i), 1.0) for i in one.indices] + [(int(i), -1.0) for i in other.indices])
        return SparseVector(size + 1, [i for i, _ in both], [v for _, v in both])

    # Plain Python functions, of the fitted rows only.
    of_text = F.udf(with_constant, VectorUDT())("marks_at").alias("features")
    of_pair = F.udf(minus, VectorUDT())("gained_at", "lost_at").alias("features")
    plain = rows.select(of_text, "toxic", F.when(F.col("toxic") == 1, TOXIC_WEIGHT).otherwise(1.0).alias("weight"))
    pairs = rows.filter("size(gained) + size(lost) > 0").select(of_pair)
    sides = F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("toxic")
    table = plain.unionByName(pairs.select("features", sides, F.lit(counterfactual / 2).alias("weight"))) if counterfactual else plain
    table = materialise(table, "toxic_rows")
    # A column that is the same in all rows would get no weight: without pairs the learner's own constant does its work.
    learner = LogisticRegression(
        labelCol="toxic", weightCol="weight", fitIntercept=table.count() == n,
        standardization=False, maxIter=100, regParam=PENALTY, elasticNetParam=1.0,
    )
    model = learner.fit(table)
    found = model.coefficients.toArray()
    return Toxicity({t: float(w) for t, w in zip(terms, found[:-1], strict=True) if w}, float(found[-1]) * CONSTANT + model.intercept)


def score(documents: DataFrame, fitted: Toxicity, columns: list[str]) -> DataFrame:
    """``columns`` and ``score``, 0 to 1, of each whole text. NULL and empty texts, and texts without a known mark, score the constant."""
    weights, constant = fitted.weights, fitted.constant
    steps: dict[str, list[tuple[int, float]]] = {}
    for mark, weight in weights.items():
        term, step = re.fullmatch(r"(.+[$*])(\d+)", mark).groups()
        steps.setdefault(term, []).append((int(step), weight))

    def start():
        known = Memo(lambda word: [t for t in terms_of(word) if t in steps])

        def answer(text: str) -> tuple[float]:
            counts: Counter[str] = Counter()
            for word, times in Counter(words_of(text)).items():
                for term in known[word]:
                    counts[term] += times
            total = constant + sum(w for term, times in sorted(counts.items()) for step, w in steps[term] if times >= step)
            return (1 / (1 + exp(-max(min(total, 500.0), -500.0))),)

        return answer

    return map_texts(documents, "text", columns, "score double", start)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is for judging only; a document without id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each row of ``documents``.

    ``labels`` has ``doc_id`` and ``toxic``, 0 or 1; rows with a NULL in either, and held-out ones, are not learned from.
    The text alone is scored. One row in, one row out, repeated ids and rows too; an empty table gives none. Further columns are not read.
    """
    learned = labels.select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    scored = score(documents, fit(documents, learned, **options), ["doc_id"])
    predicted = (F.col("score") >= TOXIC).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))
