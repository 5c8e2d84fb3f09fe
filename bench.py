"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs in full into a no-op sink, so all columns are computed.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from gate.base import bars, bench
from gate.market import returns, weekly
from gate.portfolio import book
from gate.research import CFG, data
from gate.transform import STUDY_FEATURES, STUDY_LABELS
from tapeweave.config import PreprocessConfig
from tapeweave.operators import cross_section, desk, efficacy, labels, metrics, preprocess
from tapeweave.operators.asset_features import asset_features
from tapeweave.operators.market_relative import market_relative_features
from tapeweave.plans.desk_scan import ranked_scan
from tapeweave.session import local_session

HEADLINE = {
    "bars": bars,
    "weekly_returns": returns,
    "asset_features": lambda s, sf: asset_features(bars(s, sf)),
    "market_relative": lambda s, sf: market_relative_features(bars(s, sf), bench(s, sf)),
    "percentile_rank": lambda s, sf: cross_section.percentile_rank(bars(s, sf), "close"),
    "rolling_zscore": lambda s, sf: preprocess.preprocess(bars(s, sf).select("date", "ticker", "close", "volume"), PreprocessConfig()),
    "forward_labels": lambda s, sf: labels.study_labels(bars(s, sf)),
    "ledger_by_year": lambda s, sf: metrics.performance(
        book(s, sf).withColumn("year", F.year("decision_date")), 52, ("portfolio_id", "year")
    ),
    "desk_features": lambda s, sf: desk.desk_features(bars(s, sf), CFG),
    "desk_ranked_scan": lambda s, sf: ranked_scan(bars(s, sf)),
    "spearman_pairs": lambda s, sf: efficacy.feature_label_correlations(data(s, sf), STUDY_FEATURES, STUDY_LABELS),
    "weekly_calendar": weekly,
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    bars(spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, query in HEADLINE.items():
        start = time.perf_counter()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
