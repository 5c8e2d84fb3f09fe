"""Order-free table fingerprints, run ids, and persisted run artifacts."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, is_dataclass
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeweave.operators.routing import feature_set
from tapeweave.sources.storage import write_csv, write_table

LANES = 4


def row_digest(df: DataFrame):
    """SHA-256 of a row's columns rendered as text, in name order, nulls marked."""
    mark = F.lit("\\N")
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), mark) for c in sorted(df.columns)]), 256)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: the row count and a digest that does not depend on row order.

    Row digests are added up in four 32-bit lanes, a map-side combining sum, so nothing is
    sorted or collected and repeated rows still count.
    """
    lanes = [
        F.sum(F.conv(F.substring("__d", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
        for i in range(LANES)
    ]
    summed = df.select(row_digest(df).alias("__d")).agg(
        F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *[F.coalesce(x, F.lit("0")) for x in lanes]).alias("__sum")
    )
    return summed.select("rows", F.sha2(F.concat_ws("-", F.col("rows").cast("string"), "__sum"), 256).alias("digest"))


def input_fingerprint(*tables: DataFrame) -> str:
    digest = hashlib.sha256()
    for t in tables:
        digest.update(table_fingerprint(t).first().digest.encode())
    return digest.hexdigest()


def _plain(value):
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    raise TypeError(f"A {type(value).__name__} cannot stand in the metadata.")


def run_metadata(tables, config, decision_dates: DataFrame) -> dict:
    """Provenance of a run: fingerprint, resolved configuration and an id derived from both."""
    span = decision_dates.agg(F.min("date").alias("start"), F.max("date").alias("end")).first()
    if span.start is None:
        raise ValueError("A run without decision dates has nothing to describe.")
    settings = asdict(config) if is_dataclass(config) else dict(config)
    settings["resolved_feature_columns"] = list(feature_set(settings["feature_set"]))
    text = json.dumps(settings, default=_plain, sort_keys=True)
    fingerprint = input_fingerprint(*tables)
    seed = settings.get("seed", 0)
    return {
        "run_id": hashlib.sha256((fingerprint + text + str(seed)).encode()).hexdigest()[:16],
        "created_at_utc": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "seed": seed,
        "decision_start": span.start.isoformat(),
        "decision_end": span.end.isoformat(),
        "input_fingerprint": fingerprint,
        "config": json.loads(text),
    }


def save_run(spark: SparkSession, folder: str, metadata: dict, tables: dict[str, DataFrame]) -> None:
    """One parquet table per artifact and the metadata as a one-row JSON file."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}.parquet")
    line = spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{folder}/metadata.json")


def save_report(folder: str, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}.csv")
