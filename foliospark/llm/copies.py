"""Copies of a record that differ by formatting only: white space, punctuation, letter case and the order of two fields.

Each row is brought to one canonical key in the JVM, the key is hashed to 128 bits and groups are counted with map-side
combining, so a record of a billion copies costs each task one row. A second, independent hash of 64 bits is carried
along: two keys that share the 128 bits but not these are a collision, kept apart and reported.

Null fields and fields with nothing left have a null key: such rows are no copies and belong to no record. A row
that is delivered twice under one id counts as one. Symbols, accents and digits distinguish records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import stage, table

#: White space and punctuation of any script.
LEFT_OUT = r"[\p{P}\p{Z}\s\x1c-\x1f\x85]+"
#: A group with more than this share of all rows is hot. There are fewer than 1 / share of them, whatever the data.
HOT_SHARE = 1 / 1024


def canonical(c: Column) -> Column:
    """Null if nothing is left. Case is ignored by way of upper case, so that letters with one capital are one; ß equals ss."""
    plain = F.replace(F.translate(F.lower(F.upper(F.regexp_replace(c, LEFT_OUT, ""))), "ςẞ", "σß"), F.lit("ß"), F.lit("ss"))
    return F.when(plain != "", plain)


def keyed(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, h128, h64) of the rows that are records; h128 does not depend on the order of the fields."""
    parts = F.array(*[canonical(F.col(f)) for f in fields])
    key = F.when(~F.exists(parts, lambda x: x.isNull()), F.array_join(F.array_sort(parts), "\x1f"))
    return (
        df.select(F.col(id_col).alias("id"), key.alias("key"))
        .where("id is not null and key is not null")
        .select("id", F.unhex(F.md5("key")).alias("h128"), F.xxhash64("key").alias("h64"))
    )


def records(rows: DataFrame) -> DataFrame:
    """One row per record: its smallest id and its number of copies."""
    return rows.groupBy("h128", "h64").agg(F.min("id").alias("kept_id"), F.count("*").alias("n"))


def counted(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(kept_id, n_copies) of each record, and whether another record shares its 128 bits."""
    found = records(keyed(df, id_col, fields).distinct())
    by_bits = found.groupBy("h128").agg(F.collect_list(F.struct("kept_id", "n")).alias("r"))  # one record but for collisions
    return by_bits.select(F.explode("r").alias("x"), (F.size("r") > 1).alias("collision")).select("x.kept_id", F.col("x.n").alias("n_copies"), "collision")


def copies(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(kept_id, copy_id): the smallest id of the record and each other id, once.

    The rows are brought to their keys once and written; so are the records with more than one row. The hot ones, of
    which there are provably few, are broadcast, so that their rows never meet in one task; the others are joined by
    hash, and copies delivered twice are dropped where they meet, without another shuffle."""
    rows = stage(keyed(df, id_col, fields), "keys")
    several = stage(records(rows).where("n > 1"), "records")
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    on, is_hot = ["h128", "h64"], F.col("n") > F.lit(total * HOT_SHARE)
    hot, cold = F.broadcast(several.where(is_hot).select(*on, "kept_id")), several.where(~is_hot).select(*on, "kept_id")
    of_hot = rows.join(hot, on).where("id <> kept_id").select("kept_id", F.col("id").alias("copy_id")).distinct()
    of_cold = rows.join(hot.select(*on), on, "left_anti").join(cold.hint("merge"), on).where("id <> kept_id")
    of_cold = of_cold.groupBy(*on, "kept_id", F.col("id").alias("copy_id")).agg(F.count("*").alias("n")).select("kept_id", "copy_id")
    return of_hot.unionByName(of_cold)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "glossary_sample"), "entry_id", ["term", "translation"])


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "glossary_sample"), "entry_id", ["term", "translation"])


# DuckDB's RE2 knows \p{P} and \p{Z} too.
KEY_SQL = r"""
with plain as (
  select entry_id, replace(lower(upper(regexp_replace(term, '[\p{P}\p{Z}\s]+', '', 'g'))), 'ß', 'ss') a,
         replace(lower(upper(regexp_replace(translation, '[\p{P}\p{Z}\s]+', '', 'g'))), 'ß', 'ss') b
  from glossary_sample where term is not null and translation is not null),
keyed as (select entry_id, least(a, b) x, greatest(a, b) y from plain where a <> '' and b <> ''),
grouped as (select x, y, min(entry_id) kept_id, count(*) n from keyed group by x, y)
"""
QUERIES = {"p5_found": p5_found, "p5_records": p5_records}
SQL = {
    "p5_found": KEY_SQL + "select kept_id, entry_id as copy_id from keyed join grouped using (x, y) where entry_id <> kept_id",
    "p5_records": KEY_SQL + "select kept_id, n as n_copies, false as collision from grouped",
}
