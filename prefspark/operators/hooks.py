"""The two places where outside code is plugged in.

Both run through ``mapInPandas``: Arrow batches in, Arrow batches out, and
any state (a model, a client) is built once per partition by a factory.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prefspark import constants as K



def _out_schema(df: DataFrame, out_col: str, dtype=T.StringType()) -> T.StructType:
    fields = [f for f in df.schema.fields if f.name != out_col]
    return T.StructType(fields + [T.StructField(out_col, dtype, True)])


def map_responses(df: DataFrame, fn: Callable[[list], list] | None = None,
                  text_col: str = "instruction", out_col: str = "response",
                  batch_size: int = 64,
                  make_fn: Callable[[], Callable[[list], list]] | None = None) -> DataFrame:
    """Fixed-size batches of ``text_col`` through ``fn(list[str]) -> list[str]``.

    The last batch of a partition may be short. Results are stripped (Python
    ``str.strip``); the row count is preserved and checked per batch.
    ``make_fn`` builds the function once per partition (e.g. loads a model).
    """
    if (fn is None) == (make_fn is None):
        raise ValueError("pass exactly one of fn or make_fn")
    schema = _out_schema(df, out_col)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make_fn() if make_fn is not None else fn
        buf: list[pd.DataFrame] = []
        pending = 0

        def flush(frames):
            chunk = pd.concat(frames, ignore_index=True)
            texts = chunk[text_col].tolist()
            outs = list(f(texts))
            if len(outs) != len(texts):
                raise ValueError(f"map_responses: {len(texts)} inputs but {len(outs)} outputs")
            chunk[out_col] = [o.strip() if isinstance(o, str) else o for o in outs]
            return chunk[names]

        for pdf in batches:
            start = 0
            while start < len(pdf):
                take = min(batch_size - pending, len(pdf) - start)
                buf.append(pdf.iloc[start:start + take])
                pending += take
                start += take
                if pending == batch_size:
                    yield flush(buf)
                    buf, pending = [], 0
        if pending:
            yield flush(buf)

    return df.mapInPandas(run, schema)


def map_verdicts(df: DataFrame, fn: Callable[[str], str] | None = None,
                 prompt_col: str = "judge_prompt", out_col: str = "verdict_raw",
                 max_attempts: int = K.JUDGE_MAX_ATTEMPTS,
                 backoff: Callable[[int], float] = lambda attempt: 2.0 ** attempt,
                 make_fn: Callable[[], Callable[[str], str]] | None = None,
                 concurrency: int = 1) -> DataFrame:
    """One call per row with retries; a row that still fails gets a null verdict.

    ``backoff(attempt)`` is the wait in seconds after a failed attempt
    (2 ** attempt by default). The
    answer is stripped. ``concurrency`` > 1 keeps that many calls in flight
    per task (for a network-bound judge); results stay in row order.
    """
    if (fn is None) == (make_fn is None):
        raise ValueError("pass exactly one of fn or make_fn")
    schema = _out_schema(df, out_col)
    names = [f.name for f in schema.fields]

    def call(f, prompt):
        for attempt in range(max_attempts):
            try:
                out = f(prompt)
                return out.strip() if isinstance(out, str) else out
            except Exception:  # noqa: BLE001 - any judge failure is retried
                wait = backoff(attempt)
                if wait:
                    time.sleep(wait)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make_fn() if make_fn is not None else fn
        pool = ThreadPoolExecutor(concurrency) if concurrency > 1 else None
        try:
            for pdf in batches:
                prompts = pdf[prompt_col].tolist()
                if pool is None:
                    pdf[out_col] = [call(f, p) for p in prompts]
                else:
                    pdf[out_col] = list(pool.map(lambda p: call(f, p), prompts))
                yield pdf[names]
        finally:
            if pool is not None:
                pool.shutdown()

    return df.mapInPandas(run, schema)
