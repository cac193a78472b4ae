"""Relevance labels: import, attach, update, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.results_store import require, split_known, upsert


def read_labels(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """CSV or JSON with ``submission_id`` and ``label``; other columns are optional."""
    schema = "submission_id string, label string, labeler string, confidence double, notes string"
    if fmt == "csv":
        reader = spark.read.options(header=True, enforceSchema=False, escape='"')
        header = reader.csv(path).columns
        for name in ("submission_id", "label"):
            if name not in header:
                raise ValueError("CSV must have 'submission_id' and 'label' columns")
        return reader.csv(path)
    if fmt == "json":
        return spark.read.schema(schema).json(path)
    raise ValueError("labels come as csv or json")


def normalise_labels(raw: DataFrame, labeler: str = "default", from_interface: bool = False) -> DataFrame:
    """0/1 labels with defaults; the labelling interface writes words instead of numbers."""
    if from_interface:
        label = F.when(F.col("label") == "relevant", 1).otherwise(0)
    else:
        number = F.col("label").cast("string").try_cast("int")
        label = require(number.isin(0, 1), number, "Label must be 0 or 1")

    def optional(name, kind, default):
        value = F.col(name).cast(kind) if name in raw.columns else F.lit(None).cast(kind)
        return F.coalesce(value, F.lit(default)).alias(name)

    return raw.select(
        "submission_id", label.alias("label"), optional("labeler", "string", labeler),
        optional("confidence", "double", 5.0), optional("notes", "string", ""),
    )


def attach_labels(requests: DataFrame, existing: DataFrame, docs: DataFrame,
                  allow_duplicates: bool = False) -> DataFrame:
    """Each request with its outcome: ``duplicate``, ``not_found`` or ``added``."""
    marked = split_known(requests, existing).withColumnRenamed("exists", "dup")
    marked = split_known(marked, docs).withColumnRenamed("exists", "found")
    reason = (
        F.when(F.col("dup") & F.lit(not allow_duplicates), "duplicate")
        .when(~F.col("found"), "not_found")
        .otherwise("added")
    )
    return marked.withColumn("reason", reason).drop("dup", "found")


def attach_counts(outcome: DataFrame) -> DataFrame:
    def n(reason):
        return F.count(F.when(F.col("reason") == reason, 1))

    return outcome.agg(
        F.count("*").alias("total_requested"), n("added").alias("successfully_added"),
        n("duplicate").alias("duplicates_skipped"), n("not_found").alias("failed_lookups"),
        F.try_divide(n("added"), F.count("*")).alias("success_rate"),
    )


def update_labels(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """Newest label per id; changes to unknown ids are ignored."""
    known = changes.join(labels.select("submission_id"), "submission_id", "left_semi")
    return upsert(labels, known, ["submission_id"])


def remove_labels(labels: DataFrame, ids: DataFrame) -> DataFrame:
    return labels.join(ids, "submission_id", "left_anti")


def merge_sets(sets: list[DataFrame]) -> DataFrame:
    """Rows of all training sets; duplicates stay, as each set keeps its own labels."""
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return out


def training_summary(labels: DataFrame, feature_names: list[str]) -> DataFrame:
    """Class balance, labelers, mean label confidence and a digest of the feature names."""
    return labels.agg(
        F.count("*").alias("total_samples"),
        F.sum("label").cast("bigint").alias("positive_samples"),
        F.sum(1 - F.col("label")).cast("bigint").alias("negative_samples"),
        F.avg("label").alias("class_balance"),
        F.array_join(F.sort_array(F.collect_set("labeler")), ",").alias("labelers"),
        F.avg("confidence").alias("avg_confidence"),
    ).withColumns({
        "feature_count": F.lit(len(feature_names)),
        "featurizer_hash": F.substring(F.md5(F.lit(str(feature_names))), 1, 8),
    })
