"""Flow B: prompts + model outputs -> resumable judging -> win rates.

Judge calls are the expensive, non-repeatable step, so the judged rows are
written before any metric reads them: once, under the checkpoint folder, or
slice by slice under a cache path that outlives the run. Pending rows are laid
out once, one folder a slice, so that a slice reads its own rows and no others.
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from typing import Callable

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from prefspark.operators import hooks, judge
from prefspark.session import materialize, scratch_path
from prefspark.sources import io


def judged_rows(prompts: DataFrame, model_outputs: DataFrame, judge_fn: Callable[[str], str],
                cache: DataFrame | None = None, max_attempts: int = 5,
                backoff: Callable[[int], float] = lambda a: 2.0 ** a, concurrency: int = 1,
                cache_path: str | None = None, slice_rows: int = 10_000, at_once: int = 4,
                slice_tasks: int = 1) -> DataFrame:
    """Judgment records for every prompt; cached ones are reused, failures stay pending.

    prompts: (idx, instruction, output); model_outputs: (idx, model_output).
    With ``cache_path`` (a shared folder that the caller keeps) pending rows
    are judged in slices of at most ``slice_rows``, ``at_once`` of them side by
    side, each over ``slice_tasks`` tasks. A finished slice is a folder of its
    own there: a run that breaks off loses the slices that were under way, and
    the next run, in any session, goes on from there. Pending rows are written
    once and each is read by its own slice only.
    """
    spark = prompts.sparkSession
    p = io.read_prompts(spark, prompts)
    rows = p.join(model_outputs.select("idx", "model_output"), "idx").select(
        "idx", "instruction", "model_output", F.col("output").alias("reference_output"))

    def call_judge(pending: DataFrame) -> DataFrame:
        asked = judge.judge_prompts(pending)
        answered = hooks.map_verdicts(asked, judge_fn, max_attempts=max_attempts,
                                      backoff=backoff, concurrency=concurrency)
        return judge.judgments(answered)

    empty = spark.createDataFrame([], judge.judge_rows(
        rows.withColumn("verdict_raw", F.lit(None).cast("string"))).select(*judge.JUDGMENT_COLS).schema)
    cache = empty if cache is None else cache.select(*judge.JUDGMENT_COLS)
    if cache_path is None:
        return materialize(judge.resume_judging(rows, cache, call_judge), "judgments")
    known = cache.unionByName(_judgments_under(cache_path, empty))
    pending = rows.join(known.select("idx"), "idx", "left_anti")
    queue = work_queue(pending, scratch_path(spark, "pending"), slice_rows)

    def judge_slice(path: str) -> None:
        part = spark.read.schema(pending.schema).parquet(path)
        if slice_tasks > 1:
            part = part.repartition(slice_tasks, "idx")
        call_judge(part).select(*judge.JUDGMENT_COLS).write.parquet(f"{cache_path.rstrip('/')}/slice-{uuid.uuid4().hex}")

    run_at_once([lambda path=path: judge_slice(path) for path in queue], at_once, spark)
    done = cache.join(_judgments_under(cache_path, empty).select("idx"), "idx", "left_anti").unionByName(
        _judgments_under(cache_path, empty))
    return done.join(rows.select("idx"), "idx", "left_semi")


def work_queue(pending: DataFrame, path: str, slice_rows: int) -> list[str]:
    """Writes ``pending`` under ``path`` in one pass, one folder a slice of at most ``slice_rows`` rows; gives the folders.

    A slice is a run of rows of one task, so there is no shuffle and no count beforehand.
    """
    number = F.monotonically_increasing_id()  # task << 33 | place in the task
    task, place = F.shiftright(number, 33), number.bitwiseAND(F.lit((1 << 33) - 1))
    part = F.concat_ws("-", task, F.floor(place / F.lit(slice_rows)))
    pending.withColumn("_slice", part).write.partitionBy("_slice").parquet(path)
    try:
        files = pending.sparkSession.read.schema(pending.schema).option("recursiveFileLookup", True).parquet(path).inputFiles()
    except AnalysisException:  # nothing pending
        return []
    return sorted({f"{path}/_slice={m[1]}" for m in (re.search(r"/_slice=([0-9]+-[0-9]+)/", f) for f in files) if m})


def run_at_once(jobs: list[Callable[[], None]], at_once: int, spark: SparkSession | None = None) -> None:
    """Runs the jobs, ``at_once`` side by side; after a failure no further job starts, and the failure is raised."""
    target = inheritable_thread_target(spark) if spark else lambda job: job
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        started = [pool.submit(target(j)) for j in jobs]
        done, _ = wait(started, return_when=FIRST_EXCEPTION)
        if any(f.exception() for f in done):
            pool.shutdown(wait=True, cancel_futures=True)
    for f in started:
        if not f.cancelled():
            f.result()


def _judgments_under(path: str, empty: DataFrame) -> DataFrame:
    try:
        # slices are folders; one that broke off holds nothing but hidden files
        return empty.sparkSession.read.schema(empty.schema).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException:  # nothing judged yet
        return empty


def winrate_report(judged: DataFrame) -> DataFrame:
    """One row: raw and length-controlled win rates to 2 decimals, with the fit's coefficients."""
    r = judge.lc_winrate(judged)
    return r.withColumns({c: F.round(c, 2) for c in ("raw_winrate", "lc_winrate")})
