"""Files in and out: documents, glossaries, settings, outlines."""

from __future__ import annotations

import csv
import io
import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import join, nn, strip
from foliospark.session import stage


def read_documents(spark: SparkSession, path: str, dialect: str = "python") -> DataFrame:
    """(name, text) of each UTF-8 text file; in the python dialect the name without its extension, unless files differ by
    that only, and line ends \\n."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    if dialect != "python":
        return raw.select(F.col("file").alias("name"), F.col("value").alias("text"))
    named = raw.withColumn("stem", F.regexp_replace("file", r"\.[^.]*$", ""))
    repeated = stage(named.groupBy("stem").agg(F.count("*").alias("_n")).where("_n > 1"), "stems")  # few, and small beside texts
    both = named.join(repeated, "stem", "left")
    return both.select(F.when(F.col("_n").isNull(), F.col("stem")).otherwise(F.col("file")).alias("name"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def pasted(spark: SparkSession, text: str, name: str = "Direct Input") -> DataFrame:
    """(name, text) of one text that was typed in; a blank one is no document."""
    rows = [(name, text)] if text and text.strip() else []
    return spark.createDataFrame(rows, "name string, text string")


def observed(df: DataFrame, name: str, text: str = "text") -> tuple[DataFrame, Observation]:
    """df with progress metrics (rows, characters, blank) that the next action fills, without another pass."""
    metrics = Observation(name)
    blank = F.count_if(strip(nn(F.col(text))) == "")
    return df.observe(metrics, F.count("*").alias("rows"), F.sum(F.length(text)).alias("characters"), blank.alias("blank")), metrics


def write_documents(df: DataFrame, path: str, name: str = "name", text: str = "text", suffix: str = "_output.txt") -> None:
    """One file per row, overwritten, written by the tasks: for folders that all executors share."""
    path = path.removeprefix("file://")

    def write(rows) -> None:
        os.makedirs(path, exist_ok=True)
        for row in rows:
            target = os.path.join(path, f"{row[0]}{suffix}")
            with open(f"{target}.part", "w", encoding="utf-8") as f:
                f.write(row[1] or "")
            os.replace(f"{target}.part", target)

    df.select(name, text).foreachPartition(write)


def write_partitioned(df: DataFrame, path: str, key: str, text: str) -> None:
    """The texts under one folder per key, by Spark's own writer."""
    df.select(key, text).write.mode("overwrite").partitionBy(key).text(path)


GLOSSARY = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("translation", T.StringType())]))


@F.udf(GLOSSARY, useArrow=True)
def glossary_rows(content: str | None):
    """(term, translation) of each CSV record with two fields or more, both stripped; quoted fields may hold line ends."""
    if not content:
        return []
    try:
        return [(r[0].strip(), r[1].strip()) for r in csv.reader(io.StringIO(content)) if len(r) >= 2]
    except csv.Error:
        return []


def glossary_text(content: Column) -> Column:
    """The lines `term: translation` of a glossary's CSV, its header too; null and broken content is empty."""
    return join(F.transform(glossary_rows(nn(content)), lambda r: F.concat(r["term"], F.lit(": "), r["translation"])))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(term, translation) of each record of CSV files."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(glossary_rows("value")).alias("r"))
    return rows.select("r.term", "r.translation")


def latest(files: DataFrame, key: str, at: str) -> DataFrame:
    """The last version of each file by a map-side combined maximum; ties go to the greatest content, nulls come first."""
    rest = [c for c in files.columns if c not in (key, at)]
    last = files.groupBy(key).agg(F.max(F.struct(F.coalesce(at, F.lit(-(2**63))).alias("_at"), F.col(at), *rest)).alias("x"))
    return last.select(key, *(F.col(f"x.{c}").alias(c) for c in (at, *rest)))


def listed(files: DataFrame, key: str, at: str, prefix: str = "") -> DataFrame:
    """The files whose key begins with a prefix, the newest first."""
    return files.where(F.startswith(key, F.lit(prefix))).orderBy(F.desc_nulls_last(at), key)


def upserted(stored: DataFrame, changed: DataFrame, key: str, at: str) -> DataFrame:
    return latest(stored.unionByName(changed), key, at)


def deleted(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti")


def compiled(files: DataFrame, name: str, content: str, at: str) -> DataFrame:
    """One row: the contents, the newest first, joined by line ends. The dictionary is a bounded set of files."""
    order = F.array_sort(F.collect_list(F.struct((-F.coalesce(at, F.lit(0))).alias("at"), F.col(name).alias("name"), strip(F.col(content)).alias("content"))))
    return files.where(F.col(content).isNotNull()).agg(join(F.transform(order, lambda x: x["content"])).alias("glossary"))
