"""The language-model call as an operator: prompts, a pluggable backend, retry, bounded concurrency, error modes.

A backend is any picklable callable from prompt to answer; `stub` is a deterministic one for tests. Calls are costly and
not repeatable, so answers are written as a stage table before anything reads them.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import nn
from foliospark.options import Options
from foliospark.session import ship, stage

Backend = Callable[[str], str]
# What stands in place of an answer, or after the chunk.
FAILED = {"passthrough": "\n\n(翻訳エラー)", "source": "", "marker": "[翻訳処理中にエラーが発生しました: {error}]"}


def stub(prompt: str) -> str:
    """Echoes the prompt's last paragraph in upper case."""
    return prompt.rstrip().rpartition("\n\n")[2].upper()


def echo(prompt: str) -> str:
    """A stub that gives back whole texts: what follows the prompt's last form feed, with each a as A."""
    return prompt.rpartition("\f")[2].replace("a", "A")


def filled(template: str, **values: Column) -> Column:
    """The template with its placeholders filled in one pass: braces in values are text, {{ and }} are braces."""
    parts = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece.startswith("{") and piece.endswith("}"):
            if piece[1:-1] not in values:
                raise KeyError(piece[1:-1])
            parts.append(nn(values[piece[1:-1]]))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def attempt(backend: Backend, prompt: str, options: Options, sleep: Callable[[float], None] = time.sleep) -> str:
    """One call with its retries: an empty answer is an error, delays double, none follows the last attempt."""
    error: Exception | None = None
    for k in range(options.attempts):
        try:
            if answer := backend(prompt):
                return answer
            raise ValueError("empty answer")
        except Exception as e:
            error = e
            if k + 1 < options.attempts:
                sleep(options.first_delay_s * 2**k)
    raise RuntimeError(f"model call failed after {options.attempts} attempts: {error}")


#: Calls at once in one task.
THREADS = 4


def slots(options: Options) -> tuple[int, int]:
    """Tasks, and threads in each, that make at most `concurrency` calls at once in the whole job."""
    tasks = max(1, options.concurrency // THREADS)
    return tasks, max(1, options.concurrency // tasks)


def called(df: DataFrame, prompt: Column, backend: Backend, options: Options, out: str, fallback: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """df with the column `out`: the stripped answer to each prompt.

    keys: columns that tell df's rows apart; then only these and the prompts go to Python and into the stage table, and
    the answers are joined back; without keys all columns go along. A column named `out` is replaced. `concurrency` bounds
    the calls of the whole job: the prompts are put into so few tasks, of a few threads each. on_error fail: the job ends;
    passthrough: the fallback column and a note; source: the fallback column as it is; marker: a note with the error."""
    if fallback == out:
        raise ValueError("the fallback column can't be the answer's")
    ship(df.sparkSession)
    tasks, threads = slots(options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(prompt: str, text: str | None) -> str:
            try:
                return attempt(backend, prompt, options).strip()
            except RuntimeError as e:
                if options.on_error == "fail":
                    raise
                return (text or "") + FAILED[options.on_error] if options.on_error != "marker" else FAILED["marker"].format(error=e)

        def finished(batch: pa.RecordBatch, calls: list) -> pa.RecordBatch:
            kept = [i for i, n in enumerate(batch.schema.names) if n not in ("_prompt", "_fallback")]
            answers = pa.array([c.result() for c in calls], pa.string())
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), answers], names=[*(batch.schema.names[i] for i in kept), out])

        with ThreadPoolExecutor(threads) as pool:
            waiting: tuple | None = None  # the next batch's calls begin before the last one's are done
            for batch in batches:
                prompts = batch.column(batch.schema.get_field_index("_prompt")).to_pylist()
                texts = batch.column(batch.schema.get_field_index("_fallback")).to_pylist()
                calls = [pool.submit(one, p, t) for p, t in zip(prompts, texts)]
                if waiting:
                    yield finished(*waiting)
                waiting = batch, calls
            if waiting:
                yield finished(*waiting)

    spare = F.col(fallback) if fallback and options.on_error in ("passthrough", "source") else F.lit(None)
    asked = df.select(*(keys or df.columns), prompt.alias("_prompt"), spare.cast("string").alias("_fallback")).drop(out).repartition(tasks)
    target = asked.drop("_prompt", "_fallback").withColumn(out, F.lit("")).schema
    answers = stage(asked.mapInArrow(run, target), f"model-{out}")
    return df.drop(out).join(answers, keys) if keys else answers
