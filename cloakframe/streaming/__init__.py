"""Structured Streaming wrappers of the stateless operators, and a relay of prompts and answers (extensions; A10)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming import StreamingQuery

from cloakframe.operators import risk, scan


def scanned(stream: DataFrame, text: str, config: scan.ScanConfig | None = None) -> DataFrame:
    """A stream (or table) with ``flags`` and ``cleaned`` of a text column; no state is kept."""
    return stream.withColumn("_s", scan.scan_text(F.col(text), config)).withColumns({"flags": F.col("_s.flags"), "cleaned": F.col("_s.cleaned")}).drop("_s")


def risk_by_batch(stream: DataFrame, attributes: Sequence[str], k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the small groups of every micro-batch, with the number of the batch."""
    def report(batch: DataFrame, number: int) -> None:
        risk.small_groups(batch, attributes, k).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, time: str, by: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rows per window and value; a window closes when the watermark passes it, and later rows are dropped from the stream's result."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("rows")).select(F.col("window.start").alias("start"), by, "rows")


def relay(prompts: DataFrame, answers: DataFrame, key: str, prompt_time: str, answer_time: str, wait: str = "1 hour") -> DataFrame:
    """Answers with the prompt that is waiting for them under the same key; a prompt waits no longer than ``wait``."""
    p = prompts.withWatermark(prompt_time, wait).select(F.col(key).alias("_key"), F.col(prompt_time).alias("_asked"), "prompt")
    a = answers.withWatermark(answer_time, wait)
    near = F.expr(f"{key} = _key AND {answer_time} >= _asked AND {answer_time} <= _asked + INTERVAL {wait}")
    return a.join(p, near).drop("_key")


def one_pending(events: DataFrame, key: str, order: Sequence[str], kind: str, body: str) -> DataFrame:
    """(key, prompt, answer) from a stream of prompts and answers (``kind`` is ``prompt`` or ``answer``), at most one prompt waiting per key.

    A later prompt takes the place of the one that waits; an answer takes it
    away; an answer without one is dropped. The state of a key is one prompt,
    however long its stream.
    """
    types = dict(events.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = state.get[0] if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values(list(order), kind="stable")
        for what, said in zip(rows[kind], rows[body], strict=True):
            if what == "prompt":
                waiting = said
            elif what == "answer" and waiting is not None:
                out.append((k[0], waiting, said))
                waiting = None
        if waiting is None and state.exists:
            state.remove()
        elif waiting is not None:
            state.update((waiting,))
        yield pd.DataFrame(out, columns=[key, "prompt", "answer"])

    return events.groupBy(key).applyInPandasWithState(step, f"`{key}` {types[key]}, prompt {types[body]}, answer {types[body]}", f"prompt {types[body]}", "append", "NoTimeout")
