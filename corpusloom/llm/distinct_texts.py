"""Whole-document deduplication: a 128-bit key of each text, one document for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.io import materialize
from corpusloom.operators.skew import heavy_keys

KEY = ["text_key1", "text_key2"]


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of the whole text; a null text has a key of its own."""
    return [F.xxhash64(text).alias(KEY[0]), F.xxhash64(F.lit("2"), text).alias(KEY[1])]


class DistinctTexts:
    """``keyed``: the documents with their key. ``rows``: the same without the texts, stored, so that these are read once for
    the keys and once for what is done with each distinct one. ``groups``: key, least id, number of copies. ``copies``: (id, key) of the documents
    that are not their group's least. ``heavy``: the keys with a thousandth of all documents or more.

    Only keys and ids are shuffled, combined on the map side; texts never are: ``one_each`` drops the copies by an anti join,
    for which the planner broadcasts the stored list of copies only while it is below the broadcast threshold.
    """

    def __init__(self, documents: DataFrame, identifier: str = "doc_id", text: str = "text"):
        self.identifier = identifier
        self.keyed = documents.select("*", *text_key(F.col(text)))
        self.rows = materialize(self.keyed.drop(text), "keys")
        ids = self.rows.select(identifier, *KEY)
        self.groups = materialize(ids.groupBy(*KEY).agg(F.min(identifier).alias("least"), F.count(F.lit(1)).alias("copies")), "texts")
        self.total = self.groups.agg(F.sum("copies")).first()[0] or 0
        self.heavy = materialize(heavy_keys(self.groups, KEY, "copies", self.total), "heavy")
        repeated = self.groups.filter((F.col("copies") > 1) & F.col("least").isNotNull())
        self.copies = materialize(ids.join(repeated, KEY).filter(F.col(identifier).isNull() | (F.col(identifier) != F.col("least"))).select(identifier, *KEY), "copies")

    def one_each(self) -> DataFrame:
        """One document for each text (all of them where a group has no id, or repeats its least one)."""
        k, c = self.keyed, self.copies.select(F.col(self.identifier).alias("_id"), *(F.col(x).alias(f"_{x}") for x in KEY))
        return k.join(c, k[self.identifier].eqNullSafe(c["_id"]) & (k[KEY[0]] == c[f"_{KEY[0]}"]) & (k[KEY[1]] == c[f"_{KEY[1]}"]), "left_anti")
