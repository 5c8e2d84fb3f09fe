"""Sample covariance of a listed universe, shrunk to its diagonal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tapeweave.session import cut_lineage

BLOCK = 256  # names in a block
DATES = 4096  # dates in a chunk


def shrunk_covariance(
    returns: DataFrame, tickers, shrinkage: float = 0.1, value: str = "return", on: str = "decision_date",
    block: int = BLOCK, dates: int = DATES,
) -> DataFrame:
    """``left, right, covariance`` over complete dates, off-diagonals scaled by 1 - shrinkage.

    Names are cut into blocks and dates into chunks. A task multiplies two blocks over one chunk, so it
    holds ``2 * block * dates`` numbers whatever the size of the universe, and a cell is sent once
    per block of names.
    """
    if not 0 <= shrinkage <= 1:
        raise ValueError(f"A shrinkage of {shrinkage} is no share.")
    names = list(dict.fromkeys(tickers))
    listed = returns.sparkSession.createDataFrame(list(enumerate(names)), "i int, ticker string")
    found = returns.filter(F.col(value).isNotNull()).join(listed, "ticker").groupBy(F.col(on).alias("date"), "i")
    cells = found.agg(F.first(value).cast("double").alias("x")).filter(~F.isnan("x"))
    complete = cells.groupBy("date").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(names))
    # one row per date
    chunk = F.floor((F.row_number().over(Window.orderBy("date")) - 1) / dates)
    complete = cut_lineage(complete.select("date", chunk.alias("chunk")))
    n = complete.count()
    if n < 2:
        raise ValueError(f"A covariance takes two dates on which every name has a return, not {n}.")
    cells = cells.join(complete, "date")
    cells = cells.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("i")))
    own = F.floor(F.col("i") / block).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit((len(names) - 1) // block)))
    cells = cells.select("date", "chunk", "i", "x", own.alias("own"), other.alias("other"))
    pairs = cells.select("date", "chunk", "i", "x", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
        at, seen = pd.factorize(rows["date"])
        column = rows["i"].to_numpy()
        sides = []
        for k in (low, high):
            mine = column // block == k
            x = np.zeros((len(seen), min(block, len(names) - k * block)))
            x[at[mine], column[mine] - k * block] = rows["x"].to_numpy()[mine]
            sides.append(x)
        part = sides[0].T @ sides[1]
        i, j = (m.ravel() for m in np.indices(part.shape))
        out = pd.DataFrame({"i": i + low * block, "j": j + high * block, "part": part.ravel()})
        return out if low == high else pd.concat([out, out.rename(columns={"i": "j", "j": "i"})])

    parts = pairs.groupBy("a", "b", "chunk").applyInPandas(product, "i int, j int, part double")
    summed = parts.groupBy("i", "j").agg((F.sum("part") / (n - 1)).alias("covariance"))
    kept = F.when(F.col("i") == F.col("j"), F.col("covariance")).otherwise(F.col("covariance") * (1 - shrinkage))
    out = summed.select("i", "j", kept.alias("covariance"))
    for key, label in (("i", "left"), ("j", "right")):
        out = out.join(listed.select(F.col("i").alias(key), F.col("ticker").alias(label)), key)
    return out.select("left", "right", "covariance")
