"""Households as a number (P9 for an open set): out-of-fold target encoding by aggregates and joins.

One-hot columns need a vocabulary, which for an open set of households grows
with the data. Here a household is encoded by the mean label of its training
rows, drawn towards the mean of all by ``weight`` rows of that mean:

    (sum + weight * mean) / (n + weight)

A training row would see its own label in that, so training rows are dealt to
``folds`` by their id and each takes the sums of the *other* folds (of its
household, and of all rows for the mean). Rows outside training take the sums
of all training rows.

The encoding is a table, one row a household and fold: an aggregate with
map-side combining and a join. Nothing of it comes to the driver. Households
with many rows (fewer than ``HOT`` of them, by their counted share) are joined
by broadcast; the rows of all others are shuffled by household, none of which
is large.

Defined cases: a household that training never saw, and a null one, get the
mean; rows without a label count for nothing; without any training row the
encoding is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattspark import constants as C

FOLDS, WEIGHT = 5, 20.0
#: A household with over 1/HOT of all rows and over HOT_ROWS rows is joined by broadcast.
HOT, HOT_ROWS = 2_000, 100_000


def fold_of(row_id: str = "reading_id", folds: int = FOLDS) -> Column:
    """The fold of a row, from the part of its id that the train / test split does not use."""
    return F.pmod(F.floor(F.col(row_id) / C.TEST_FRACTION_BUCKETS), F.lit(folds)).cast("int")


def means(train: DataFrame, label: str = C.LABEL, row_id: str = "reading_id", folds: int = FOLDS) -> Column:
    """The mean label without each fold (0 ..) and, last, of all training rows: an array from one aggregate."""
    known = train.where(F.col(label).isNotNull()).select(fold_of(row_id, folds).alias("_f"), F.col(label).alias("_y"))
    return known.select(F.array(*[F.avg(F.when(F.col("_f") != f, F.col("_y"))) for f in range(folds)], F.avg("_y"))).scalar()


def encoding_table(train: DataFrame, key: str = "household_id", label: str = C.LABEL, row_id: str = "reading_id",
                   folds: int = FOLDS, weight: float = WEIGHT) -> DataFrame:
    """(household, n, encodings): for every household of the training rows the value for each fold and, last, for other rows."""
    sums = train.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("household"), fold_of(row_id, folds).alias("_f")).agg(
        F.sum(label).alias("_s"), F.count(F.lit(1)).alias("_n"))
    others = [F.col("_f") != f for f in range(folds)] + [F.lit(True)]
    parts = [(F.coalesce(F.sum(F.when(o, F.col("_s"))), F.lit(0.0)).alias(f"_s{i}"), F.coalesce(F.sum(F.when(o, F.col("_n"))), F.lit(0)).alias(f"_n{i}"))
             for i, o in enumerate(others)]
    wide = sums.groupBy("household").agg(F.sum("_n").alias("n"), *[c for pair in parts for c in pair])
    mean = means(train, label, row_id, folds)
    values = [(F.col(f"_s{i}") + weight * F.get(mean, F.lit(i))) / (F.col(f"_n{i}") + F.lit(weight)) for i in range(folds + 1)]
    return wide.select("household", "n", F.array(*values).alias("encodings"))


def with_encoding(rows: DataFrame, train: DataFrame, name: str = "household_encoding", key: str = "household_id", label: str = C.LABEL,
                  row_id: str = "reading_id", in_training: Column | None = None, folds: int = FOLDS, weight: float = WEIGHT) -> DataFrame:
    """``rows`` with the encoding of their household. in_training: which of them are training rows (default: split = 'train')."""
    in_training = F.col("split") == "train" if in_training is None else in_training
    table = encoding_table(train, key, label, row_id, folds, weight).select(F.col("household").alias("_h"), "n", F.col("encodings").alias("_e"))
    total = train.select(F.count(F.lit(1))).scalar()
    hot = (F.col("n") > HOT_ROWS) & (F.col("n") * HOT > total)
    at = F.when(F.coalesce(in_training, F.lit(False)), fold_of(row_id, folds)).otherwise(F.lit(folds))
    src = rows.withColumn("_at", at).join(F.broadcast(table.where(hot).drop("n")), F.col(key) == F.col("_h"), "left")
    done = F.col("_h").isNotNull() | F.col(key).isNull()  # these are not shuffled
    rest = src.where(~done).drop("_h", "_e").join(table.where(~hot).drop("n"), F.col(key) == F.col("_h"), "left")
    out = src.where(done).unionByName(rest)
    value = F.coalesce(F.get("_e", F.col("_at")), F.get(means(train, label, row_id, folds), F.col("_at")))
    return out.withColumn(name, value).drop("_h", "_e", "_at")
