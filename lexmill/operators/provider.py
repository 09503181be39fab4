"""The boundary to language models and embeddings: pluggable, deterministic stubs by default."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from ..functions.text import ws_tokens


@dataclass
class Provider:
    """Column functions; a user's provider wraps its client in a pandas UDF. ``judge`` replies with text that holds a JSON
    object; ``choose`` scores how promising a section is for a question by its title and summary."""

    generate: Callable[[Column], Column]
    judge: Callable[[Column, Column], Column]
    rerank: Callable[[Column, Column], Column]
    summarize: Callable[[Column], Column]
    embed: Callable[[Column], Column]
    choose: Callable[[Column, Column, Column], Column] = lambda question, title, summary: F.lit(0.0)


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """Signed feature hashing of the text's tokens to ``size`` dimensions; a null text has none of them."""

    @arrow_udf("array<float>")
    def summed(hashes: pa.Array) -> pa.Array:
        n = len(hashes)
        length = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False)
        values = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.repeat(np.arange(n), length) * size + values % size
        found = np.bincount(place, np.where(values > 0, 1.0, -1.0), n * size).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(found))

    return summed(F.transform(ws_tokens(text), lambda w: F.xxhash64(w)))


def shared_words(question: Column, title: Column, summary: Column) -> Column:
    """How many of a question's words are in a section's title or summary: a choice without a model."""
    return F.size(F.array_intersect(ws_tokens(question), ws_tokens(F.concat_ws(" ", title, summary)))).cast("double")


STUB = Provider(
    generate=lambda prompt: F.lit(""),
    judge=lambda answer, reference: F.lit(None).cast("string"),
    rerank=lambda question, passage: F.lit(0.5),
    summarize=lambda text: F.substring(text, 1, 200),
    embed=hashed_embedding,
)


def with_retries(
    call: Callable[[str], object], attempts: int = 3, wait: float = 1.0, timeout: float = 120.0, concurrency: int = 5, kind: str = "string"
) -> Callable[[DataFrame, str, str], DataFrame]:
    """A row-wise client call as a column of ``out`` (of type ``kind``), ``error`` and ``attempts``.

    A failed attempt is made again, up to ``attempts`` in all, with waits that double between. An attempt that has not answered after
    ``timeout`` seconds counts as failed and is left behind. A task makes ``concurrency`` calls at a time. What fails at last
    is an error record; the job goes on. A null text is not sent: it has no answer, no error and no attempts.
    """
    import queue
    import threading
    import time
    from concurrent.futures import ThreadPoolExecutor

    def attempt(text: str) -> tuple[object, str]:
        box: queue.Queue = queue.Queue(1)

        def work() -> None:
            try:
                box.put((call(text), ""))
            except Exception as e:
                box.put((None, f"[ERROR] {e}"))

        threading.Thread(target=work, daemon=True).start()  # one that hangs must not keep the worker from ending
        try:
            return box.get(timeout=timeout)
        except queue.Empty:
            return None, f"[ERROR] no answer within {timeout:g} s"

    def answered(text: str | None) -> tuple[object, str, int]:
        if text is None:
            return None, "", 0
        for n in range(1, attempts + 1):
            out, error = attempt(text)
            if not error or n == attempts:
                return out, error, n
            time.sleep(wait * 2 ** (n - 1))
        return None, "", 0

    @pandas_udf(f"out {kind}, error string, attempts int")
    def run(texts: pd.Series) -> pd.DataFrame:
        with ThreadPoolExecutor(concurrency) as pool:
            return pd.DataFrame(list(pool.map(answered, texts)), columns=["out", "error", "attempts"])

    return lambda frame, column, name: frame.withColumn(name, run(F.col(column)))


def retried_embedding(call: Callable[[str], list[float]], **settings) -> Callable[[DataFrame, str, str], DataFrame]:
    """``with_retries`` for a client that embeds one text."""
    return with_retries(call, kind="array<float>", **settings)
