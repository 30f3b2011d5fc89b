"""Calling a model or judge over a whole DataFrame in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOADED: dict[str, Callable] = {}


def _load_once(token: str, make_fn: Callable[[], Callable]) -> Callable:
    """One scorer per Python worker process and run; later tasks reuse it."""
    if token not in _LOADED:
        _LOADED.clear()
        _LOADED[token] = make_fn()
    return _LOADED[token]


def _call(scorer: Callable, batch: pd.DataFrame) -> list[tuple[str | None, str | None]]:
    """(output, error) per row. A failing batch is retried by halves, down to the rows that fail: failure is data."""
    try:
        outputs = list(scorer(batch))
        if len(outputs) != len(batch):
            raise ValueError(f"{len(batch)} rows in, {len(outputs)} outputs out")
        return [(None if o is None else str(o), None) for o in outputs]
    except Exception as error:
        if len(batch) == 1:
            return [(None, str(error) or type(error).__name__)]
        half = len(batch) // 2
        return _call(scorer, batch.iloc[:half]) + _call(scorer, batch.iloc[half:])


def score(
    df: DataFrame,
    make_fn: Callable[[], Callable[[pd.DataFrame], Sequence[str]]],
    inputs: Sequence[str] = ("prompt",),
    settings: Sequence[str] = (),
    batch_size: int = 32,
    output: str = "raw",
    skip: str | None = None,
    partitions: int | None = None,
    error_as_output: bool = False,
) -> DataFrame:
    """Add ``output`` and ``error`` by a batch callable.

    A row whose call fails has a NULL output and the reason in ``error``, so that it can be told from an answer and tried
    again; ``error_as_output`` puts the reason into the output as well, as records of judging have it.

    ``make_fn()`` loads the model; the callable it returns takes a frame with the
    columns ``inputs`` and ``settings`` and returns one text per row. Each call sees at
    most ``batch_size`` rows with equal settings. Rows whose ``skip`` column is not
    NULL get that note as output and are never sent. Only the named columns travel to
    Python; the others wait on the JVM side, so nothing has to be joined back.
    ``partitions`` spreads few rows over all slots of an expensive scorer.
    """
    token = uuid.uuid4().hex
    shown = list(dict.fromkeys([*inputs, *settings]))

    @F.pandas_udf("struct<output: string, error: string>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _load_once(token, make_fn)
        for frame in batches:
            frame = frame.reset_index(drop=True)
            found: list[tuple[str | None, str | None]] = [(None, None)] * len(frame)
            # equal settings have equal keys, made on the JVM side
            for _, group in frame.loc[frame["_send"]].groupby("_settings", sort=False):
                group = group[shown]
                for start in range(0, len(group), batch_size):
                    batch = group.iloc[start : start + batch_size]
                    for i, result in zip(batch.index, _call(scorer, batch)):
                        found[i] = result
            yield pd.DataFrame(found, columns=["output", "error"], dtype=object)

    # A call may be expensive and need not repeat exactly: the plan must hold it once.
    run = run.asNondeterministic()
    send = F.lit(True) if skip is None else F.col(skip).isNull()
    sent = [F.when(send, F.col(c)).alias(c) for c in shown]
    source = df.repartition(partitions) if partitions else df
    alike = F.to_json(F.struct(*[F.col(c) for c in settings])) if settings else F.lit("")
    scored = source.withColumn("_scored", run(F.struct(send.alias("_send"), alike.alias("_settings"), *sent)))
    text = F.col("_scored.output")
    if error_as_output:
        text = F.coalesce(text, F.col("_scored.error"))
    if skip is not None:
        text = F.coalesce(F.col(skip), text)
    return scored.withColumns({output: text, "error": F.col("_scored.error")}).drop("_scored")
