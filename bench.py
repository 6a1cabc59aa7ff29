"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from lodestone.operators import occurrences, view
    from lodestone.operators.model import Filter, Kind, Query, Sort, from_frame
    from lodestone.plans.queries import queries

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sunk = lambda df: df.write.format("noop").mode("overwrite").save()
    docs = from_frame(table("documents").select("doc_id", "text", "lang", "source"), ["doc_id"], ["doc_id", "text", "lang", "source"])
    orders = from_frame(table("orders"), ["o_orderkey"], table("orders").columns)
    lines = from_frame(table("lineitem"), ["l_orderkey", "l_linenumber"], table("lineitem").columns)
    names = table("lineitem").columns
    price, flag = names.index("l_extendedprice"), names.index("l_returnflag")
    total = table("orders").columns.index("o_totalprice")

    jobs = {
        "search_any_cell": lambda: sunk(view.matching(docs, Query("tion"))),
        "sort_exact_number": lambda: sunk(view.run(orders, Query(sort=Sort(total, True, Kind.NUMBER))).slice(0, 256)),
        "filter_and_sort": lambda: sunk(view.run(lines, Query(filters=(Filter(flag, "equals", "r"),), sort=Sort(price, False, Kind.NUMBER))).slice(0, 256)),
        "count_occurrences": lambda: sunk(docs.df.agg(F.sum(F.regexp_count("c1", F.lit("(?iu)the"))))),
        "find_occurrences": lambda: occurrences.counts(occurrences.hits(docs, "the", columns=[1])),
        "top_k": lambda: sunk(view.top(orders, Query(sort=Sort(total, True, Kind.NUMBER)), 100)),
    }
    found = queries()
    for name in ("flt_09_conjunction", "srch_04_ext", "srt_04_timestamp", "inf_01_types", "imp_05_forward_fill"):
        jobs[name] = lambda f=found[name]: sunk(f(spark, sf_dir))
    times = {}
    for name, job in jobs.items():
        job()  # compiles code
        began = time.perf_counter()
        job()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "sum of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
