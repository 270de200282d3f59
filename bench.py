"""Headline queries, timed warm; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pricewell.plans import load_all  # noqa: E402
from pricewell.session import get_spark  # noqa: E402

HEADLINE = ["best_offer_per_variant", "price_catalog_rollup", "header_dedupe", "line_filter", "publication_plan", "suppress_window", "markup_override",
            "ngram_resolve", "page_prices", "two_step_lookup"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark("bench", cpus=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()[0]

    def run(name: str) -> float:
        t = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - t

    seconds = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(statistics.median([run(name) for _ in range(3)]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
