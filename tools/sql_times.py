"""Median time of every query's SQL on DuckDB, as JSON: ``python tools/sql_times.py [folder] [threads]``."""

import json
import statistics
import sys
import time

sys.path.insert(0, __file__.rsplit("/", 1)[0])

from check import connect  # noqa: E402

from jobscope.entries import ORACLES  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = connect(sf_dir)
    con.execute(f"SET threads = {sys.argv[2] if len(sys.argv) > 2 else 8}")
    times = {}
    for name, sql in ORACLES.items():
        seconds = []
        for _ in range(2):
            start = time.perf_counter()
            con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {sql}")
            seconds.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seconds), 3)
    print(json.dumps(times))


if __name__ == "__main__":
    main()
