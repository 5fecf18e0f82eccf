"""Questions to a model: tasks, prompts, the model hook, and joining the answers back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.operators.clauses import sentinel
from clauseloom.operators.ingest import chunks
from clauseloom.options import ModelOptions
from clauseloom.taxonomy import ABSENT_TEXT, TASK_NAMES, prompt_frame

RESPONSE_SCHEMA = (
    "contract_id string, task string, chunk_no int, attempt int, status string, value string, message string"
)

# A model hook takes a list of requests, as many as an Arrow batch holds, and returns their answers in order. A request
# has the keys system, prompt, max_tokens, temperature and task.
Model = Callable[[list[dict]], Sequence[str | None]]


def _task_settings(options: ModelOptions) -> list[tuple[str, int, float]]:
    return [
        (name, options.max_tokens_summary, options.temperature_summary)
        if name == "summary"
        else (name, options.max_tokens_clause, options.temperature_extraction)
        for name in TASK_NAMES
    ]


def tasks(contracts: DataFrame, options: ModelOptions = ModelOptions()) -> DataFrame:
    """Each contract once per task: its own columns plus ``task``, ``max_tokens`` and ``temperature``."""
    rows = [
        F.struct(
            F.lit(name).alias("task"), F.lit(tokens).alias("max_tokens"), F.lit(temperature).alias("temperature")
        )
        for name, tokens, temperature in _task_settings(options)
    ]
    return contracts.select(*contracts.columns, F.inline(F.array(*rows)))


def prompt(text: Column | str, task: str, options: ModelOptions = ModelOptions()) -> Column:
    """Prompt of one task over a whole text."""
    _, before, after = prompt_frame(task, options.library)
    return F.concat(F.lit(before), F.col(text) if isinstance(text, str) else text, F.lit(after))


def _asked(rows: DataFrame, keys: Sequence[str], text: Column, options: ModelOptions, names: Sequence[str]) -> DataFrame:
    settings = {name: (tokens, temperature) for name, tokens, temperature in _task_settings(options)}
    asked = [
        F.struct(
            F.lit(name).alias("task"),
            F.lit(prompt_frame(name, options.library)[0]).alias("system"),
            prompt(text, name, options).alias("prompt"),
            F.lit(settings[name][0]).alias("max_tokens"),
            F.lit(settings[name][1]).alias("temperature"),
        )
        for name in names
    ]
    return rows.select(*keys, F.inline(F.array(*asked))).withColumn("tokens", T.estimate_tokens("prompt"))


def prompts(
    contracts: DataFrame, options: ModelOptions = ModelOptions(), names: Sequence[str] = TASK_NAMES,
    size: int | None = 4_000,
) -> DataFrame:
    """One row per contract and task: system line, prompt, model settings and the estimated prompt tokens.

    The prompt holds the first ``size`` characters of the text, or all of it with None. ``chunked_prompts`` asks about
    every part of a long text.
    """
    text = F.col("text") if size is None else T.head("text", size)
    return _asked(contracts, ["contract_id"], text, options, names)


def chunked_prompts(
    contracts: DataFrame, size: int = 4_000, options: ModelOptions = ModelOptions(), names: Sequence[str] = TASK_NAMES
) -> DataFrame:
    """One row per contract, chunk of ``size`` characters and task, so that no part of a text goes unasked."""
    return _asked(chunks(contracts, size), ["contract_id", "chunk_no"], F.col("chunk"), options, names)


def _read_answer(task: str, answer: str | None) -> tuple[str | None, str, str | None]:
    """(value, status, message) of one answer: None is an error, an empty one or the agreed phrase means absent."""
    if answer is None:
        return None, "error", "no answer"
    text = str(answer).strip()
    said = text.rstrip(".").strip().lower()
    if not said or said == ABSENT_TEXT.format(name=task).lower():
        return None, "absent", None
    return text, "found", None


def answer(prompt_rows: DataFrame, model: Model, attempt: int = 1) -> DataFrame:
    """Run a caller-supplied model over prompts, one call per Arrow batch, inside Spark tasks.

    If a call raises or returns another number of answers, the batch's requests are sent one by one, so a failure
    stays with its own row: it gets ``status`` error with the message, and the others go on.
    """
    columns = ["contract_id", "task", "system", "prompt", "max_tokens", "temperature"]
    chunk = F.col("chunk_no") if "chunk_no" in prompt_rows.columns else F.lit(0)

    def ask(requests: list[dict]) -> list[tuple[str | None, str, str | None]]:
        try:
            answers = list(model(requests))
            if len(answers) != len(requests):
                raise ValueError(f"{len(answers)} answers to {len(requests)} requests")
            return [_read_answer(r["task"], a) for r, a in zip(requests, answers)]
        except Exception as error:  # noqa: BLE001 - one failed call must not fail the job
            if len(requests) == 1:
                return [(None, "error", f"{type(error).__name__}: {error}")]
            return [ask([request])[0] for request in requests]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            requests = frame.drop(columns=["chunk_no", "contract_id"]).to_dict("records")
            keys = zip(frame["contract_id"], frame["task"], frame["chunk_no"])
            out = [(*key, attempt, status, value, message) for key, (value, status, message) in zip(keys, ask(requests))]
            yield pd.DataFrame(
                out, columns=["contract_id", "task", "chunk_no", "attempt", "status", "value", "message"], dtype=object
            )

    return prompt_rows.select(*columns, chunk.cast("int").alias("chunk_no")).mapInPandas(run, RESPONSE_SCHEMA)


def chunked_answers(responses: DataFrame) -> DataFrame:
    """One response per contract and task out of those to its chunks, each chunk's best one.

    A task failed if a chunk of it did. Otherwise the values found are joined in the order of the chunks; a task
    without any is absent.
    """
    best = best_responses(responses, ("contract_id", "task", "chunk_no"))
    found = F.sort_array(F.collect_list(F.when(F.col("status") == "found", F.struct("chunk_no", "value"))))
    joined = best.groupBy("contract_id", "task").agg(
        F.max("attempt").alias("attempt"),
        F.bool_or(F.col("status") == "error").alias("failed"),
        F.array_join(F.transform(found, lambda f: f["value"]), " ").alias("text"),
        F.bool_or(F.col("status") == "found").alias("any"),
    )
    status = F.when(F.col("failed"), "error").when(F.col("any"), "found").otherwise("absent")
    return joined.select(
        "contract_id", "task", "attempt", status.alias("status"),
        F.when(~F.col("failed") & F.col("any"), F.col("text")).alias("value"),
    )


def best_responses(responses: DataFrame, keys: Sequence[str] = ("contract_id", "task")) -> DataFrame:
    """One response per contract and task, or other keys: the latest success, or else the latest failure."""
    order = F.struct((F.col("status") != "error").alias("ok"), "attempt")
    body = F.struct("attempt", "status", "value")
    return (
        responses.groupBy(*keys)
        .agg(F.max_by(body, order).alias("best"))
        .select(*keys, "best.attempt", "best.status", "best.value")
    )


def task_results(task_rows: DataFrame, responses: DataFrame) -> DataFrame:
    """Every task with its response; a task without one counts as failed.

    ``value`` is null unless found; ``shown`` carries the agreed phrases for absent and failed tasks.
    """
    joined = task_rows.select("contract_id", "task").join(best_responses(responses), ["contract_id", "task"], "left")
    return joined.select(
        "contract_id", "task", F.coalesce("status", F.lit("error")).alias("status"), "value"
    ).withColumn("shown", sentinel("task", "status", "value"))


def pending_tasks(
    task_rows: DataFrame, responses: DataFrame, max_attempts: int = 3, keys: Sequence[str] = ("contract_id", "task")
) -> DataFrame:
    """Tasks to send (again): no success so far and fewer than ``max_attempts`` tries; ``attempt`` is the next one."""
    tried = responses.groupBy(*keys).agg(
        F.max("attempt").alias("_tries"), F.bool_or(F.col("status") != "error").alias("_done")
    )
    tries, done = F.coalesce("_tries", F.lit(0)), F.coalesce("_done", F.lit(False))
    return (
        task_rows.select(*keys)
        .join(tried, list(keys), "left")
        .filter(~done & (tries < max_attempts))
        .select(*keys, (tries + 1).alias("attempt"))
    )


def wide_results(results: DataFrame, value: str = "shown") -> DataFrame:
    """One row per contract with one column per task."""
    wide = results.groupBy("contract_id").pivot("task", list(TASK_NAMES)).agg(F.first(value))
    return wide.select(
        "contract_id",
        *[F.col(n).alias(n if n == "summary" else f"{n}_clause") for n in TASK_NAMES],
    )
