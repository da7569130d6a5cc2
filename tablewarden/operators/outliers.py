"""Row outliers by agreement of four detectors, and what drives each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.columns import as_double, col, normalize_missing, numeric_columns, present
from tablewarden.functions.runtime import materialize, spread_out, together
from tablewarden.operators.density import noise_1d, noise_nd, standardised
from tablewarden.operators.forest import fit_forest, row_score, value_score
from tablewarden.operators.quantiles import medians
from tablewarden.operators.values import value_counts

Z_LIMIT = 3.0
MAD_LIMIT = 3.5
MAD_FACTOR = 0.6745
FOREST_LIMIT = 0.80
DENSITY_EPS = 3.0
BROADCAST_ROWS = 100_000
# Detector names in the order in which they are listed.
DETECTORS = {"z_vote": "Z-SCORE", "mad_vote": "MAD", "iso_vote": "ISOLATION FOREST", "dbscan_vote": "DBSCAN"}


def spreads(df: DataFrame, columns: list[str], robust: bool = True) -> dict[str, dict[str, float | None]]:
    """Mean, sample and population deviation, count, median and median deviation per column."""
    aggs = []
    for i, c in enumerate(columns):
        v = as_double(c)
        aggs += [
            F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
            F.stddev_pop(v).alias(f"p{i}"), F.count(v).alias(f"n{i}"),
        ]
    row = df.agg(*aggs).first()
    found = {
        c: {"mean": row[f"m{i}"], "std": row[f"s{i}"], "pop": row[f"p{i}"], "count": row[f"n{i}"]}
        for i, c in enumerate(columns)
    }
    if robust:
        middle = medians(df, columns)
        gaps = df.select(
            *[F.abs(as_double(c) - F.lit(middle[c])).alias(c) for c in columns if middle[c] is not None]
        )
        mad = medians(gaps, gaps.columns)
        for c in columns:
            found[c].update(median=middle[c], mad=mad.get(c))
    return found


def _scaled(value: Column, center: float | None, spread: float | None, factor: float = 1.0) -> Column:
    if center is None or not spread:
        return F.lit(0.0)
    return F.coalesce(F.lit(factor) * F.abs(value - F.lit(center)) / F.lit(spread), F.lit(0.0))


def z_score(name: str, s: dict) -> Column:
    return _scaled(as_double(name), s["mean"], s["std"])


def mad_score(name: str, s: dict) -> Column:
    return _scaled(as_double(name), s["median"], s["mad"], MAD_FACTOR)


def _largest(scores: list[Column]) -> Column:
    return scores[0] if len(scores) == 1 else F.greatest(*scores)


def z_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add ``z_score`` (largest over the columns) and ``z_vote``."""
    df = normalize_missing(df)
    names = numeric_columns(df) if columns is None else columns
    s = spreads(df, names, robust=False)
    scored = df.withColumn("z_score", _largest([z_score(c, s[c]) for c in names]))
    return scored.withColumn("z_vote", F.col("z_score") > Z_LIMIT)


def mad_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add ``mad_score`` (largest over the columns) and ``mad_vote``."""
    df = normalize_missing(df)
    names = numeric_columns(df) if columns is None else columns
    s = spreads(df, names)
    scored = df.withColumn("mad_score", _largest([mad_score(c, s[c]) for c in names]))
    return scored.withColumn("mad_vote", F.col("mad_score") > MAD_LIMIT)


def forest_scores(df: DataFrame, columns: list[str] | None = None, row_key: str | None = None) -> DataFrame:
    """Add ``isolation_forest``: anomaly score of complete rows, NULL for the others."""
    df = normalize_missing(df)
    names = numeric_columns(df) if columns is None else columns
    values = [as_double(c) for c in names]
    rows = df.select(*[v.alias(c) for v, c in zip(values, names)], *([] if row_key is None or row_key in names else [row_key]))
    forest = fit_forest(rows.dropna(subset=names), names, row_key)
    return df.withColumn("isolation_forest", row_score(df.sparkSession, forest, values))


def min_max(df: DataFrame, column: str, output: str) -> DataFrame:
    """Add a column scaled to 0..1 over its present values; 0 if it is constant."""
    row = df.agg(F.min(col(column)).alias("low"), F.max(col(column)).alias("high")).first()
    low, high = row["low"], row["high"]
    if low is None or high <= low:
        return df.withColumn(output, F.when(col(column).isNotNull(), F.lit(0.0)))
    return df.withColumn(output, (col(column).cast("double") - F.lit(float(low))) / F.lit(float(high - low)))


def min_samples_for(rows: int) -> int:
    return max(5, int(rows * 0.01))


def density_noise(
    df: DataFrame, columns: list[str], output: str = "dbscan", eps: float = DENSITY_EPS, min_samples: int | None = None
) -> DataFrame:
    """Add 0/1 for rows that are density noise over the standardised columns.

    Rows with missing values are not noise.
    """
    df = normalize_missing(df)
    rows = df.count()
    needed = min_samples or min_samples_for(rows)
    values = {c: as_double(c) for c in columns}
    complete = df.select(*[v.alias(c) for c, v in values.items()]).dropna()
    s = spreads(complete, columns, robust=False)
    if s[columns[0]]["count"] < needed:
        return df.withColumn(output, F.lit(0))
    scaled = {c: standardised(values[c], s[c]["mean"], s[c]["pop"]) for c in columns}
    keys = [f"_z{i}" for i in range(len(columns))]
    wide = df.select("*", *[scaled[c].alias(k) for c, k in zip(columns, keys)])
    points = wide.select(*keys).dropna()
    if len(keys) == 1:
        counts = points.groupBy(F.lit("x").alias("column"), F.col(keys[0]).alias("value")).agg(
            F.count(F.lit(1)).alias("n")
        )
        limits = df.sparkSession.createDataFrame([("x", needed)], "column string, min_samples bigint")
        noise = noise_1d(counts, limits, eps).select(F.col("value").alias(keys[0]))
    else:
        noise = noise_nd(points, needed, eps)
    noise = materialize(noise.withColumn("_noise", F.lit(1)))
    side = F.broadcast(noise) if noise.count() <= BROADCAST_ROWS else noise
    # A partly missing row has a NULL key and so never matches.
    return wide.join(side, keys, "left").select(*df.columns, F.coalesce("_noise", F.lit(0)).alias(output))


def flag_outliers(
    df: DataFrame,
    columns: list[str] | None = None,
    exclude: list[str] | None = None,
    min_votes: int = 2,
    row_key: str | None = None,
    use_forest: bool = True,
) -> DataFrame:
    """The rows of ``df`` with every detector's score and vote, the vote count, the verdict and,
    for outliers, the column that drives it.

    Without numeric columns no row is an outlier.
    """
    df = normalize_missing(df)
    names = present(df, columns) if columns is not None else numeric_columns(df, exclude or [])
    if not names:
        empty = {c: F.lit(0.0) for c in ("z_score", "mad_score", "isolation_forest")}
        scored = df.select("*", *[v.alias(c) for c, v in empty.items()], F.lit(0).alias("dbscan"))
        votes = scored.select("*", *[F.lit(False).alias(v) for v in DETECTORS])
        return _with_driver(_with_votes(votes, min_votes), [], {})
    s, scored = together(lambda: spreads(df, names), lambda: density_noise(df, names))
    if use_forest:
        scored = materialize(forest_scores(spread_out(materialize(scored)), names, row_key))
        scored = min_max(scored, "isolation_forest", "_iso")
    else:
        scored = scored.withColumn("isolation_forest", F.lit(0.0)).withColumn("_iso", F.lit(0.0))
    votes = (
        scored.withColumn("z_score", _largest([z_score(c, s[c]) for c in names]))
        .withColumn("mad_score", _largest([mad_score(c, s[c]) for c in names]))
        .withColumn("isolation_forest", F.coalesce("isolation_forest", F.lit(0.0)))
        .withColumn("z_vote", F.col("z_score") > Z_LIMIT)
        .withColumn("mad_vote", F.col("mad_score") > MAD_LIMIT)
        .withColumn("iso_vote", F.coalesce(F.col("_iso") > FOREST_LIMIT, F.lit(False)))
        .withColumn("dbscan_vote", F.col("dbscan") == 1)
        .drop("_iso")
    )
    return _with_driver(_with_votes(votes, min_votes), names, s)


def _with_votes(votes: DataFrame, min_votes: int) -> DataFrame:
    total = sum((F.col(v).cast("int") for v in DETECTORS), F.lit(0))
    listed = F.concat_ws(", ", *[F.when(F.col(v), F.lit(name)) for v, name in DETECTORS.items()])
    return (
        votes.withColumn("vote_count", total)
        .withColumn("is_outlier", F.col("vote_count") >= min_votes)
        .withColumn("detectors_triggered", F.when(F.col("is_outlier"), listed).otherwise(""))
    )


def _with_driver(flagged: DataFrame, names: list[str], s: dict) -> DataFrame:
    if not names:
        return flagged.select(
            "*",
            F.lit(None).cast("string").alias("primary_anomaly_column"),
            F.lit(None).cast("double").alias("anomaly_value"),
            F.lit(None).cast("string").alias("anomaly_reason"),
        )
    # Largest score wins; on ties the earlier column does.
    candidates = F.array(
        *[
            F.struct(
                F.greatest(z_score(c, s[c]), mad_score(c, s[c])).alias("score"),
                F.lit(-i).alias("order"),
                F.lit(c).alias("column"),
                F.coalesce(as_double(c), F.lit(0.0)).alias("value"),
                F.coalesce(as_double(c) > F.lit(s[c]["median"]), F.lit(False)).alias("high"),
            )
            for i, c in enumerate(names)
        ]
    )
    side = F.when(F.col("_driver.high"), "high").otherwise("low")
    reason = F.concat(
        F.col("_driver.column"), F.lit(" contains an unusually "), side,
        F.lit(" value compared to the dataset distribution."),
    )
    return flagged.withColumn("_driver", F.when(F.col("is_outlier"), F.array_max(candidates))).select(
        *flagged.columns,
        F.col("_driver.column").alias("primary_anomaly_column"),
        F.col("_driver.value").alias("anomaly_value"),
        F.when(F.col("_driver").isNotNull(), reason).alias("anomaly_reason"),
    )


def outlier_summary(flagged: DataFrame) -> DataFrame:
    """One row: outliers, their share and each detector's share, in percent."""
    def share(flag: str) -> Column:
        return F.coalesce(F.avg(F.col(flag).cast("double")) * 100, F.lit(0.0))

    return flagged.agg(
        F.count_if("is_outlier").alias("total_outliers"),
        share("is_outlier").alias("percentage_flagged"),
        share("z_vote").alias("z_score"),
        share("mad_vote").alias("mad_score"),
        share("iso_vote").alias("isolation_forest"),
        share("dbscan_vote").alias("dbscan"),
    )


def top_outliers(flagged: DataFrame, row_key: str, k: int | None = None) -> DataFrame:
    """All outliers, or the first ``k`` in key order (a top-k per task and one merge)."""
    found = flagged.where("is_outlier")
    return found if k is None else found.orderBy(col(row_key)).limit(k)


def univariate_outliers(
    df: DataFrame, columns: list[str] | None = None, use_forest: bool = True, min_values: int = 10
) -> DataFrame:
    """``column, outlier_percentage``: agreement of the detectors on each column alone.

    Works on distinct values with their counts, all columns in one table. Columns of at most
    ten values get 0.
    """
    df = normalize_missing(df)
    spark = df.sparkSession
    names = numeric_columns(df) if columns is None else columns
    s = spreads(df, names)
    rows = df.count()
    used = [c for c in names if s[c]["count"] > min_values]
    listed = spark.createDataFrame([(c,) for c in names], "column string")
    if not used:
        return listed.withColumn("outlier_percentage", F.lit(0.0))
    counts = materialize(value_counts(df, used, "double"))
    facts = spark.createDataFrame(
        [
            (c, s[c]["mean"], s[c]["std"] or None, s[c]["pop"] or 1.0, s[c]["median"], s[c]["mad"] or None,
             min_samples_for(rows))
            for c in used
        ],
        "column string, mean double, std double, pop double, median double, mad double, min_samples bigint",
    )
    scored = (
        counts.join(F.broadcast(facts), "column")  # one row per column
        .withColumn("z", F.round((F.col("value") - F.col("mean")) / F.col("pop"), 9))
        .withColumn("z_vote", F.coalesce(F.abs(F.col("value") - F.col("mean")) / F.col("std") > Z_LIMIT, F.lit(False)))
        .withColumn(
            "mad_vote",
            F.coalesce(
                F.lit(MAD_FACTOR) * F.abs(F.col("value") - F.col("median")) / F.col("mad") > MAD_LIMIT, F.lit(False)
            ),
        )
    )
    points = scored.groupBy("column", F.col("z").alias("value")).agg(F.sum("n").alias("n"))
    # A column with fewer values than the density minimum has no noise at all.
    few = [c for c in used if s[c]["count"] < min_samples_for(rows)]
    noise = (
        noise_1d(points, facts.select("column", "min_samples"), DENSITY_EPS)
        .where(~F.col("column").isin(few))
        .select("column", F.col("value").alias("z"), F.lit(True).alias("noise"))
    )
    scored = scored.join(noise, ["column", "z"], "left").withColumn(
        "dbscan_vote", F.coalesce("noise", F.lit(False))
    )
    forest = fit_forest(df.select(*[as_double(c).alias(c) for c in used]), used, per_column=True) if use_forest else None
    if forest is None:
        scored = scored.withColumn("iso_vote", F.lit(False))
    else:
        scored = materialize(scored.withColumn("iso", value_score(spark, forest, F.col("column"), F.col("value"))))
        ranges = scored.groupBy("column").agg(F.min("iso").alias("lo"), F.max("iso").alias("hi"))
        scored = scored.join(F.broadcast(ranges), "column").withColumn(
            "iso_vote",
            F.coalesce(F.try_divide(F.col("iso") - F.col("lo"), F.col("hi") - F.col("lo")) > FOREST_LIMIT, F.lit(False)),
        )
    votes = sum((F.col(v).cast("int") for v in DETECTORS), F.lit(0))
    shares = scored.groupBy("column").agg(
        F.coalesce(F.sum(F.when(votes >= 2, F.col("n"))), F.lit(0)).alias("flagged")
    )
    return listed.join(shares, "column", "left").select(
        "column",
        F.round(F.coalesce(F.col("flagged"), F.lit(0)) * 100.0 / F.lit(rows), 2).alias("outlier_percentage"),
    )
