"""Table profiles: moments, quantiles, outliers, frequent values, correlations, histograms."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lanewright.functions.numbers import flag, rnd_total
from lanewright.operators.quantiles import exact_quantiles
from lanewright.policy import COLUMN_MEANING, IQR_SPAN
from lanewright.session import materialize


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def other_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NumericType)]


def unpivot(df: DataFrame, columns: list[str], text: bool = True) -> DataFrame:
    """Long form (column_name, value) of the non-null cells."""
    kind = "string" if text else "double"
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast(kind).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("e")).select("e.*").filter("value is not null")


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n).  Counts combine on the map side, so a hot value is one row per task."""
    return unpivot(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values per column, ties by value."""
    order = Window.partitionBy("column_name").orderBy(F.col("n").desc(), "value")
    ranked = value_frequencies(df, columns).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)  # the rank filter also limits each map task to k rows per column


def quartile_fences(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float] | None]:
    quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    fences: dict[str, tuple[float, float] | None] = {}
    for c in columns:
        q1, q3 = quartiles[c][0.25], quartiles[c][0.75]
        fences[c] = None if q1 is None else (q1 - IQR_SPAN * (q3 - q1), q3 + IQR_SPAN * (q3 - q1))
    return fences


def _outside(column: str, fence) -> Column:
    if fence is None:
        return F.lit(0)
    return F.coalesce(F.sum(flag((F.col(column) < fence[0]) | (F.col(column) > fence[1]))), F.lit(0))


def _long(one_row: DataFrame, columns: list[str], fields: dict) -> DataFrame:
    """A one-row aggregate with columns ``<column>~<field>`` as one row per column."""
    cells = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}~{name}`").cast(kind).alias(name) for name, kind in fields.items()])
        for c in columns
    ]
    return one_row.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    fences = quartile_fences(df, columns)
    counts = df.agg(*[_outside(c, fences[c]).alias(f"{c}~outliers") for c in columns])
    return _long(counts, columns, {"outliers": "bigint"})


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Five-number summary per column."""
    probs = {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}
    numbers = exact_quantiles(df, columns, list(probs.values()))
    rows = [(c, *[numbers[c][p] for p in probs.values()]) for c in columns]  # one row per column
    schema = "column_name string, " + ", ".join(f"{n} double" for n in probs)
    made = df.sparkSession.createDataFrame(rows, schema)
    return made.select("column_name", *[rnd_total(F.col(n), 4).alias(n) for n in probs])


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, missing, distinct, and for numbers moments, median, outliers, negatives."""
    df = materialize(df, "profiled")  # read by every pass below; a view of joins would be worked out anew each time
    numeric = numeric_columns(df)
    columns = df.columns
    medians = exact_quantiles(df, numeric, [0.25, 0.5, 0.75])
    fences = {
        c: None if q[0.25] is None else (q[0.25] - IQR_SPAN * (q[0.75] - q[0.25]), q[0.75] + IQR_SPAN * (q[0.75] - q[0.25]))
        for c, q in medians.items()
    }
    kinds = dict(df.dtypes)
    exprs: list[Column] = []
    for c in columns:
        col = F.col(f"`{c}`")
        n = F.count(col)
        exprs += [
            F.lit(kinds[c]).alias(f"{c}~dtype"),
            (F.count("*") - n).alias(f"{c}~missing_count"),
            rnd_total((F.count("*") - n) * 100 / F.count("*"), 3).alias(f"{c}~missing_pct"),
            F.count("*").alias(f"{c}~n_rows"),
        ]
        if c in numeric:
            unbiased = F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2)
            numbers = {
                "mean": rnd_total(F.avg(col), 4),
                "median": rnd_total(F.lit(medians[c][0.5]), 4),
                "std": rnd_total(F.stddev_samp(col), 4),
                "minimum": F.min(col),
                "maximum": F.max(col),
                "skewness": rnd_total(F.when(n > 2, unbiased), 4),
                "outlier_count_iqr": _outside(f"`{c}`", fences[c]),
                "negative_value_count": F.coalesce(F.sum(flag(col < 0)), F.lit(0)),
            }
        else:
            numbers = dict.fromkeys(
                ("mean", "median", "std", "minimum", "maximum", "skewness", "outlier_count_iqr", "negative_value_count"), F.lit(None)
            )
        exprs += [v.alias(f"{c}~{name}") for name, v in numbers.items()]
    fields = {
        "dtype": "string", "missing_count": "bigint", "missing_pct": "double", "n_rows": "bigint", "mean": "double",
        "median": "double", "std": "double", "minimum": "double", "maximum": "double", "skewness": "double",
        "outlier_count_iqr": "bigint", "negative_value_count": "bigint",
    }
    wide = _long(df.agg(*exprs), columns, fields)
    distinct = value_frequencies(df, columns).groupBy("column_name").agg(F.count("*").alias("unique_count"))
    joined = wide.join(distinct, "column_name", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
    return joined.withColumn("cardinality_ratio", rnd_total(F.col("unique_count") / F.col("n_rows"), 4)).drop("n_rows")


def column_annotations(profile: DataFrame, meanings: dict[str, str] = COLUMN_MEANING) -> DataFrame:
    """Adds the business meaning of each column, N/A when it is not in the dictionary."""
    table = F.create_map(*[F.lit(x) for pair in meanings.items() for x in pair])
    return profile.withColumn("business_meaning", F.coalesce(F.try_element_at(table, F.col("column_name")), F.lit("N/A")))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical row."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicates, missing cells and the column lists, from one shuffle of distinct rows."""
    columns = df.columns
    copies = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    missing = [F.sum(F.when(F.col(c).isNull(), F.col("_n")).otherwise(0)).alias(f"_m_{c}") for c in columns]
    sums = copies.agg(F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_duplicates"), *missing)
    per_column = [F.col(f"_m_{c}") for c in columns]
    with_gap = F.array_join(F.array(*[F.when(F.col(f"_m_{c}") > 0, F.lit(c)) for c in sorted(columns)]), ",")
    return sums.select(
        "n_rows",
        F.lit(len(columns)).cast("bigint").alias("n_columns"),
        "n_duplicates",
        sum(per_column[1:], per_column[0]).alias("missing_cells"),
        with_gap.alias("columns_with_missing"),
        F.lit(",".join(sorted(numeric_columns(df)))).alias("numeric_columns"),
        F.lit(",".join(sorted(other_columns(df)))).alias("categorical_columns"),
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair over its complete rows; one aggregate, no data shuffle."""
    pairs = list(combinations(range(len(columns)), 2))
    known = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    wide = df.agg(
        *[
            F.corr(F.when(known(columns[i], columns[j]), F.col(columns[i])), F.when(known(columns[i], columns[j]), F.col(columns[j]))).alias(f"_{i}_{j}")
            for i, j in pairs
        ]
    )
    cells = [
        F.struct(
            F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.lit(i).alias("a_pos"), F.lit(j).alias("b_pos"),
            F.col(f"_{i}_{j}").alias("corr"),
        )
        for i, j in pairs
    ]
    return wide.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal-width bins from minimum to maximum; the last bin is closed."""
    ends = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    x = F.col(column)
    spread = df.select(x, ends.alias("e")).filter(x.isNotNull())
    width = F.col("e.hi") - F.col("e.lo")
    place = F.when(width > 0, F.floor((x - F.col("e.lo")) / width * bins)).otherwise(F.lit(0))
    return spread.select(F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def target_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


