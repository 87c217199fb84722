"""Speedups over thread counts, Amdahl's curve and the serial share that fits best."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Example runs (threads, milliseconds), for the registered queries.
EXAMPLE = ((1, 8000.0), (2, 4600.0), (4, 2900.0), (8, 2050.0))
STAGES = (("io", 120.0), ("tokenize_tfidf", 900.0), ("minhash_lsh", 450.0), ("similarity", 330.0), ("perplexity", 200.0))
CURVE_SHARE = 0.15  # fixed value: the serial share that the drawn curve assumes
CURVE_THREADS = (1, 2, 4, 8, 16)


def points(spark: SparkSession, runs: Iterable[tuple[int, float]] = EXAMPLE) -> DataFrame:
    return spark.createDataFrame(list(runs), "threads int, runtime_ms double")


def thread_speedup(runs: DataFrame) -> DataFrame:
    """(threads, runtime_ms, speedup, efficiency) against the run with the fewest threads; a few rows."""
    base = runs.agg(F.min_by("runtime_ms", "threads").alias("base"))
    speedup = F.col("base") / F.col("runtime_ms")
    return runs.crossJoin(F.broadcast(base)).select("threads", "runtime_ms", speedup.alias("speedup"), (speedup / F.col("threads")).alias("efficiency"))


def amdahl(share, threads):
    return 1.0 / (share + (1.0 - share) / threads)


def amdahl_fit(runs: DataFrame) -> DataFrame:
    """(serial_share, error): of the shares 0, 0.001 ... 1 the first with the least squared error; 0 for fewer
    than two runs."""
    shares = runs.sparkSession.range(1001).select((F.col("id") / 1000.0).alias("serial_share"))
    measured = thread_speedup(runs)
    errors = shares.crossJoin(F.broadcast(measured)).groupBy("serial_share").agg(F.sum(F.pow(F.col("speedup") - amdahl(F.col("serial_share"), F.col("threads")), 2)).alias("error"), F.count(F.lit(1)).alias("n"))
    best = errors.agg(F.min(F.struct("error", "serial_share")).alias("best"), F.max("n").alias("n"))
    return best.select(F.when(F.col("n") >= 2, F.col("best.serial_share")).otherwise(0.0).alias("serial_share"), F.when(F.col("n") >= 2, F.col("best.error")).otherwise(0.0).alias("error"))


def amdahl_curve(spark: SparkSession, share: float = CURVE_SHARE, threads: Iterable[int] = CURVE_THREADS) -> DataFrame:
    found = spark.createDataFrame([(t,) for t in threads], "threads int")
    bound = amdahl(F.lit(share), F.col("threads"))
    return found.select("threads", F.round(bound, 6).alias("speedup"), F.round(bound / F.col("threads"), 6).alias("efficiency"))


def stage_shares(stages: DataFrame) -> DataFrame:
    """(stage, ms, share) of (stage, ms); 0 if nothing took time."""
    total = stages.agg(F.sum("ms").alias("total"))
    return stages.crossJoin(F.broadcast(total)).select("stage", "ms", F.when(F.col("total") > 0, F.col("ms") / F.col("total")).otherwise(0.0).alias("share"))


def sweep(run: Callable[[int], dict], threads: Iterable[int] = (1, 2, 4, 8)) -> list[dict]:
    """A row for each thread count: what run(threads) reports, its wall time, and the speedup over the first."""
    rows: list[dict] = []
    for n in threads:
        began = time.time()
        row = {"threads": n, **run(n)}
        row["wall_ms"] = (time.time() - began) * 1000
        row.setdefault("runtime_ms", row["wall_ms"])
        row["speedup"] = rows[0]["runtime_ms"] / row["runtime_ms"] if rows and row["runtime_ms"] else 1.0
        rows.append(row)
    return rows


_RUNS = "runs(threads, runtime_ms) AS (VALUES " + ", ".join(f"({t}, {ms}::DOUBLE)" for t, ms in EXAMPLE) + ")"
_SPEED = "speed AS (SELECT threads, arg_min(runtime_ms, threads) OVER () / runtime_ms AS speedup FROM runs)"
SQL = {
    "amdahl_fit": f"WITH {_RUNS}, {_SPEED}, e AS (SELECT k / 1000 AS s, sum(pow(speedup - 1 / (k / 1000 + (1 - k / 1000) / threads), 2)) AS error FROM speed, range(1001) r(k) GROUP BY k) SELECT round(s, 3) AS serial_share, round(error, 9) AS error FROM e ORDER BY e.error, s LIMIT 1",
    "amdahl_curve": "SELECT t::INTEGER AS threads, round(1 / (0.15::DOUBLE + 0.85::DOUBLE / t), 6) AS speedup, round(1 / (0.15::DOUBLE + 0.85::DOUBLE / t) / t, 6) AS efficiency FROM (VALUES (1), (2), (4), (8), (16)) v(t)",
    "stage_share": "WITH s(stage, ms) AS (VALUES " + ", ".join(f"('{n}', {ms}::DOUBLE)" for n, ms in STAGES) + ") SELECT stage, ms, round(ms / sum(ms) OVER (), 6) AS share FROM s",
    "thread_speedup": f"WITH {_RUNS}, {_SPEED} SELECT threads::INTEGER AS threads, round(speedup, 6) AS speedup, round(speedup / threads, 6) AS efficiency FROM speed",
}
