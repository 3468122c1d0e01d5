"""Problem 7: records that differ in formatting only, collapsed and counted.

Each normalised (field name, value) pair is hashed; a record's fingerprint is
the sum of its pairs' hashes, so the order of fields plays no part and nothing
is sorted. Records are grouped by fingerprint with map-side combining, and each
member's fields are then compared with those of the kept record. A member that
only collides is grouped by its fields instead of its fingerprint.

Defined results: null counts as empty; a record without any letter or digit in
its text says nothing and is a copy of no other; rows without an id are left
out; rows delivered twice are one record; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.canon import field_pairs, multiset_hash, same_multiset, squeeze
from foliospark.plans.scale import cut, salted_join


def fingerprints(df: DataFrame, id_col: str, text_col: str, plain_cols: list[str]) -> DataFrame:
    """(id, fields, fp): ``text_col`` may hold labelled fields, ``plain_cols`` are one field each."""
    pairs: Column = field_pairs(F.col(text_col), text_col)
    if plain_cols:
        pairs = F.concat(pairs, F.array(*(F.concat(F.lit(f"{c}="), squeeze(F.col(c))) for c in plain_cols)))
    return (
        df.where(F.col(id_col).isNotNull() & (squeeze(F.col(text_col)) != ""))
        .select(F.col(id_col).alias("id"), pairs.alias("fields"))
        .withColumn("fp", multiset_hash(F.col("fields")))
    )


def assign(df: DataFrame, id_col: str, text_col: str, plain_cols: list[str]) -> DataFrame:
    """(id, kept_id): each record with the smallest id of its group, one row per record.

    A fingerprint that a third of all rows share is joined back in salts.
    """
    recs = cut(fingerprints(df, id_col, text_col, plain_cols))  # canonicalised once
    groups = recs.groupBy("fp").agg(F.min("id").alias("kept"), F.min_by("fields", "id").alias("kept_fields"), F.count("*").alias("n"))
    joined = (
        salted_join(recs, groups, "fp", "n", F.col("id"))
        .withColumn("same", same_multiset(F.col("fields"), F.col("kept_fields")))
        .select("id", "kept", "same", F.when(~F.col("same"), F.array_sort("fields")).alias("odd"))
    )
    joined = cut(joined)
    good = joined.where("same").select("id", F.col("kept").alias("kept_id"))
    odd = joined.where("not same")
    again = odd.groupBy("odd").agg(F.min("id").alias("kept_id"))
    return good.unionByName(odd.join(again, "odd").select("id", "kept_id")).distinct()


def copies(df: DataFrame, id_col: str = "task_id", text_col: str = "instruction", plain_cols: tuple[str, ...] = ("task_type",)) -> DataFrame:
    """(kept_task_id, copy_task_id): every record that repeats an earlier one."""
    a = assign(df, id_col, text_col, list(plain_cols))
    return a.where(F.col("id") != F.col("kept_id")).select(F.col("kept_id").alias("kept_task_id"), F.col("id").alias("copy_task_id"))


def collapsed(df: DataFrame, id_col: str = "task_id", text_col: str = "instruction", plain_cols: tuple[str, ...] = ("task_type",)) -> DataFrame:
    """(kept_task_id, n_records): one row per group with the number of records in it."""
    a = assign(df, id_col, text_col, list(plain_cols))
    return a.groupBy(F.col("kept_id").alias("kept_task_id")).agg(F.count("*").alias("n_records"))
