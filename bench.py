"""Seconds of the headline queries on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR``; one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillstack.functions import identifiers as ids
from quillstack.plans import predicates
from quillstack.plans.fixtures import corpus, library
from quillstack.plans.q_records import QUERIES as RECORDS
from quillstack.plans.q_search import QUERIES as SEARCHES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def timed(f) -> float:
    began = time.time()
    f()
    return round(time.time() - began, 3)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark.range(1000))
    out: dict[str, float] = {}
    index = library(spark, SF).cache()
    out["index_build"] = timed(lambda: run(index))
    docs = index.count()
    texts = corpus(spark, SF).cache()
    out["full_text_build"] = timed(lambda: run(texts))
    for name, df, query in (("field", index, "author:supplier#00000001"), ("boolean", index, "(author:000000001 OR author:000000007) year:<1996 -type:urgent"), ("full_text", texts, '"of the" -idiot')):
        predicates.search(df, query, ("citekey",)).collect()
        out[f"warm_{name}"] = min(timed(lambda: predicates.search(df, query, ("citekey",)).collect()) for _ in range(3))
    found = spark.read.parquet(f"{SF}/documents.parquet").select(ids.find_dois(F.col("text")), ids.find_arxiv(F.col("text")), ids.find_isbns(F.col("text")))
    out["identifiers"] = timed(lambda: run(found))
    for name in ("f_17_scan", "w_02_best_evidence", "a_06_first_wins"):
        out[name] = timed(lambda: run(RECORDS[name](spark, SF)))
    out["ranking"] = timed(lambda: RECORDS["o_04_limit"](spark, SF).collect())
    out["sync"] = timed(lambda: run(SEARCHES["t_01_sync"](spark, SF)))
    rates = {"index_docs_per_s": round(docs / out["index_build"]), "warm_query_s": out["warm_boolean"]}
    print(json.dumps({"metric": "sum of headline queries", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "rates": rates, "sf": SF}))


if __name__ == "__main__":
    main()
