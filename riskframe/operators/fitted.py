"""Statistics fitted on training rows and applied unchanged everywhere else."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.rowwise import MISSING_CATEGORY
from riskframe.operators.quantiles import exact_quantiles, quantile_values
from riskframe.spec import TableSpec

# The fence factor, quantiles and the sampling defaults.
FENCE = 1.5
THRESHOLD_QUANTILES = (0.25, 0.75, 0.95, 0.99)
PROFILE_QUANTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)
NEGATIVES_PER_POSITIVE = 3.0
SEED = 42

MOST_LITERAL_CATEGORIES = 1000


@dataclass(frozen=True)
class AmountThresholds:
    p25: float
    p75: float
    p95: float
    p99: float

    @property
    def iqr(self) -> float:
        return self.p75 - self.p25

    @property
    def upper_cap(self) -> float:
        return self.p75 + FENCE * self.iqr


def fit_amount_thresholds(train: DataFrame, amount: str) -> AmountThresholds:
    found = quantile_values(train, [amount], THRESHOLD_QUANTILES)[amount]
    return AmountThresholds(*(found[p] for p in THRESHOLD_QUANTILES))


def amount_thresholds_table(train: DataFrame, amount: str) -> DataFrame:
    """The thresholds as one row."""
    at = {p: F.max(F.when(F.col("probability") == p, F.col("value"))) for p in THRESHOLD_QUANTILES}
    p25, p75, p95, p99 = (at[p] for p in THRESHOLD_QUANTILES)
    return (
        exact_quantiles(train, [amount], THRESHOLD_QUANTILES)
        .agg(p95.alias("p95"), p99.alias("p99"), p25.alias("p25"), p75.alias("p75"))
        .withColumn("iqr", F.col("p75") - F.col("p25"))
        .withColumn("upper_cap", F.col("p75") + F.lit(FENCE) * F.col("iqr"))
    )


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum and seven quantiles, one row per column that has values."""
    names = {p: f"p{round(p * 100):02d}" for p in PROFILE_QUANTILES}
    quantiles = (
        exact_quantiles(df, columns, PROFILE_QUANTILES)
        .groupBy("column_name")
        .agg(*[F.max(F.when(F.col("probability") == p, F.col("value"))).alias(n) for p, n in names.items()])
    )
    ends = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.max(F.col(c).cast("double")).alias("max"),
            )
            for c in columns
        ]
    )
    extremes = df.agg(ends.alias("ends")).select(F.explode("ends").alias("e")).select("e.*")
    return extremes.join(quantiles, "column_name")


def medians_table(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    return exact_quantiles(train, columns, [0.5]).select("column_name", F.col("value").alias("median"))


def fit_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Median per column. A column without any training value has no median and
    cannot be imputed, which is an error rather than a silent NULL."""
    found = quantile_values(train, columns, [0.5])
    empty = [c for c in columns if not found[c]]
    if empty:
        raise ValueError(f"no training value for: {', '.join(empty)}")
    return {c: found[c][0.5] for c in columns}


def impute(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """Numeric columns as double with NULL and NaN replaced by the frozen median."""
    filled = {}
    for name, median in medians.items():
        value = F.col(name).cast("double")
        filled[name] = F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(float(median)))
    return df.withColumns(filled)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair over the rows that have both values."""
    value = {c: F.col(c).cast("double") for c in columns}
    pairs = {(a, b): F.corr(value[a], value[b]) for i, a in enumerate(columns) for b in columns[i:]}
    cells = [
        F.struct(
            F.lit(a).alias("row_name"),
            F.lit(b).alias("column_name"),
            F.col(f"{min(a, b, key=columns.index)}__{max(a, b, key=columns.index)}").alias("correlation"),
        )
        for a in columns
        for b in columns
    ]
    single = df.agg(*[c.alias(f"{a}__{b}") for (a, b), c in pairs.items()])
    return single.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def class_weights_table(train: DataFrame, label: str) -> DataFrame:
    """Balanced weights: total / (2 x class rows), one row per class."""
    positive = F.count(F.when(F.col(label) == 1, 1))
    negative = F.count(F.when(F.col(label) == 0, 1))
    total = (positive + negative).cast("double")

    def entry(value: int, rows: Column) -> Column:
        weight = total / (F.greatest(rows, F.lit(1)) * 2)
        return F.struct(F.lit(value).alias("label"), rows.alias("rows"), weight.alias("class_weight"))

    both = F.array(entry(0, negative), entry(1, positive))
    return train.agg(both.alias("both")).select(F.explode("both").alias("e")).select("e.*")


def fit_class_weights(train: DataFrame, label: str) -> dict[int, float]:
    return {row["label"]: row["class_weight"] for row in class_weights_table(train, label).collect()}


def with_class_weight(df: DataFrame, label: str, weights: Mapping[int, float]) -> DataFrame:
    weight = F.when(F.col(label) == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    return df.withColumn("class_weight", weight)


def sample_order(id_column: str, seed: int) -> Column:
    """Repeatable pseudo-random order that does not depend on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_column).cast("string")))


def sample_rows(df: DataFrame, id_column: str, n: int, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same ones on every run."""
    total = df.count()
    if n >= total:
        return df
    return _lowest(df, id_column, n, total, seed)


def _lowest(df: DataFrame, id_column: str, n: int, total: int, seed: int) -> DataFrame:
    """The ``n`` lowest rows in sample order, without sorting the table.

    A row's place in [0, 1) follows from its digest. All rows below a safe lower
    mark are in, all above a safe upper mark are out, and only the band between
    them is ranked; the band holds a few standard deviations of rows. The band
    is counted first, so the result is exact even when it has to be widened.
    """
    order = sample_order(id_column, seed)
    place = F.conv(F.substring(order, 1, 12), 16, 10).cast("double") / float(16**12)
    tagged = df.withColumn("__order", order).withColumn("__place", place)
    share = n / total
    slack = 6 * (share * (1 - share) / total) ** 0.5 + 64 / total
    while True:
        low, high = share - slack, share + slack
        below, upto = tagged.agg(
            F.count(F.when(F.col("__place") < low, 1)), F.count(F.when(F.col("__place") <= high, 1))
        ).first()
        if below <= n <= upto:
            break
        slack *= 4
    band = tagged.filter((F.col("__place") >= low) & (F.col("__place") <= high))
    last = band.orderBy("__order", id_column).limit(n - below)
    return tagged.filter(F.col("__place") < low).unionByName(last).drop("__order", "__place")


def undersample(
    df: DataFrame, id_column: str, label: str, ratio: float = NEGATIVES_PER_POSITIVE, seed: int = SEED
) -> DataFrame:
    """All positives and exactly ``ratio`` negatives per positive, as far as there are any."""
    counts = {row[label]: row["count"] for row in df.groupBy(label).count().collect()}
    positives, negatives = counts.get(1, 0), counts.get(0, 0)
    wanted = min(negatives, int(positives * ratio))
    kept = df.filter(F.col(label) == 0)
    if wanted < negatives:
        kept = _lowest(kept, id_column, wanted, negatives, seed)
    return df.filter(F.col(label) == 1).unionByName(kept)


def category_index(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes per category: most frequent first, ties by name. NULL has no code."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("category")) for c in columns]
    )
    by_frequency = Window.partitionBy("column_name").orderBy(F.col("rows").desc(), "category")
    return (
        train.select(F.explode(entries).alias("e"))
        .select("e.*")
        .filter(F.col("category").isNotNull())
        .groupBy("column_name", "category")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("code", (F.row_number().over(by_frequency) - 1).cast("int"))
    )


def encode_categories(df: DataFrame, index: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace categories by their code; unseen ones get the number of known codes.

    A small index (checked) becomes a literal map; a larger one is joined.
    """
    entries = index.limit(MOST_LITERAL_CATEGORIES + 1).collect()
    if len(entries) > MOST_LITERAL_CATEGORIES:
        return _encode_by_join(df, index, columns)
    coded = {}
    for column in columns:
        known = {r["category"]: r["code"] for r in entries if r["column_name"] == column}
        unseen = F.lit(float(len(known)))
        if not known:
            coded[column] = unseen
            continue
        pairs = [F.lit(part) for item in sorted(known.items()) for part in (item[0], float(item[1]))]
        code = F.try_element_at(F.create_map(*pairs), F.coalesce(F.col(column).cast("string"), F.lit("")))
        coded[column] = F.when(F.col(column).isNull(), unseen).otherwise(F.coalesce(code, unseen))
    return df.withColumns(coded)


def _encode_by_join(df: DataFrame, index: DataFrame, columns: Sequence[str]) -> DataFrame:
    sizes = {r["column_name"]: r["count"] for r in index.groupBy("column_name").count().collect()}
    for column in columns:
        codes = index.filter(F.col("column_name") == column).select(
            F.col("category").alias("__category"), F.col("code").cast("double").alias("__code")
        )
        df = (
            df.join(codes, F.col(column).cast("string") == F.col("__category"), "left")
            .withColumn(column, F.coalesce("__code", F.lit(float(sizes.get(column, 0)))))
            .drop("__category", "__code")
        )
    return df


def fill_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(MISSING_CATEGORY, subset=list(columns))


def amount_by_class(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Mean and exact median amount per label."""
    means = df.groupBy(spec.label).agg(F.avg(F.col(spec.amount).cast("double")).alias("avg_amount"))
    medians = exact_quantiles(df, [spec.amount], [0.5], by=[spec.label]).select(
        spec.label, F.col("value").alias("median_amount")
    )
    return means.join(medians, spec.label, "left")
