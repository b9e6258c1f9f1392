"""What the models of this package take from a corpus: bounded samples, and the commonest words of all texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import stage

#: Rows that a sample's threshold lets through, as a multiple of those wanted, as some may be null.
SPARE = 3
#: Distinct words in a task's counter before it is passed on.
FLUSH = 300_000
#: Steps by which a word count doubles, when the least count of a common word is sought.
STEPS = 8


_built: dict = {}


def built(shared, build: Callable):
    """What `build` makes of a broadcast's value, made once in each worker; the last one is kept, with the value, for an
    id stands for another value once the first is gone."""
    value = shared.value
    if _built.get("of") is not value or _built.get("by") is not build:
        _built.clear()
        _built.update(of=value, by=build, made=build(value))
    return _built["made"]


def sample(df: DataFrame, key: str, longest: dict[str, int], size: int) -> pa.Table:
    """At most `size` rows of the columns, chosen by a hash of the key, of those whose texts are no longer than `longest`.

    For fitting models only: bounded in rows and characters, and of whole texts. Rows with a null in a column are left
    out. The rows of df are counted, without reading the columns; a threshold on the hash lets few times as many rows
    through as are wanted, so that few move however many there are."""
    part = min(1.0, SPARE * size / max(1, df.count()))
    some = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(part * (1 << 30)) + 1).where(" and ".join(f"length(`{c}`) <= {k}" for c, k in longest.items()))
    return some.select(F.xxhash64(key).alias("h"), *longest).orderBy("h").limit(size).drop("h").toArrow()


class Words(dict):
    """Words with their counts, and the greatest count that a word which isn't among them may have."""

    left_out = 1


def common_words(df: DataFrame, columns: list[str], count: Callable[[str, Counter], None], clean: Callable[[str], str], size: int) -> Words:
    """The commonest words of all texts with their counts, at most `size`, words that occur once left out. What else is
    left out has a count known not to exceed `left_out`.

    Each task counts its texts and passes on one row per word. The counts are written once; the least count is sought in
    their histogram, so no task sorts them, and ties stand in or out together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for w, n in counts.items():
                if p := clean(w):
                    words[p] += n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for column in batch.columns:
                for t in column.to_pylist():
                    if t:
                        count(t, counts)
                        if len(counts) > FLUSH:
                            yield flush()
        yield flush()

    counted = df.select(*columns).mapInArrow(run, "word string, n bigint").where(F.length("word").between(1, 40)).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counted = stage(counted, "words")
    step = F.floor(F.log2("n") * STEPS).cast("int")
    least, total, left_out = None, 0, 1
    for row in sorted(counted.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.max("n").alias("most")).collect(), reverse=True):
        total += row.n
        if total > size:
            left_out = row.most
            break
        least = row.s
    out = Words()
    if least is not None:
        rows = counted.where(step >= least).toArrow()
        out.update(sorted(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist())))
    out.left_out = left_out
    return out
