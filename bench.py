"""Times the log queries: median of three warm runs each, fully materialised. Prints one JSON line."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarrylog.plans import catalog
from quarrylog.session import local_session


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    took = {}
    for name, query in catalog.QUERIES.items():
        runs = []
        for _ in range(4):  # the first warms up
            began = time.perf_counter()
            query(spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name.split("_")[0]] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "total of the log queries' median seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rpartition("sf")[2], "cores": cores, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
