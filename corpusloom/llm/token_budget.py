"""Problem 2: tokens of every document, and their totals by source, language and mail domain.

Whole documents are hashed and deduplicated, each distinct text is tokenized once, and the exact counts are joined back to
the keys: for totals to the number of copies in each slice, so that a text with many copies costs one row for each slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.io import materialize
from corpusloom.llm.distinct_texts import KEY, DistinctTexts
from corpusloom.llm.tokens import VOCABULARY, with_token_count
from corpusloom.operators.skew import heavy_keys, salted_join


def canonical(name: Column) -> Column:
    """One spelling of a source: lower case, letters and digits only; blank and null become '(none)'."""
    bare = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", "(none)").otherwise(bare)


def mail_domain(address: Column) -> Column:
    domain = F.substring_index(F.lower(F.trim(address)), "@", -1)
    return F.when(F.coalesce(domain, F.lit("")) == "", "(none)").otherwise(domain)


class TokenBudget:
    """Columns used: documents doc_id, text, lang, artifact_id, owner_email; evidence artifact_id, token_count, source_guess, owner_email.

    A null or empty text has 0 tokens and counts as a document. Repeated rows of ``documents`` each count. A null
    ``artifact_id`` matches nothing. Of several evidence rows of one artifact (resumed runs), the greatest non-blank value of
    a column is taken. Empty tables give empty results.
    """

    def __init__(self, documents: DataFrame, evidence: DataFrame, vocabulary: str = VOCABULARY):
        self.texts = DistinctTexts(documents.select("doc_id", "text", "lang", "artifact_id", "owner_email"))
        self.keyed = self.texts.rows
        counted = with_token_count(self.texts.one_each().select(*KEY, "text"), "text", "tokens", vocabulary)
        self.tokens = counted.groupBy(*KEY).agg(F.max("tokens").alias("tokens"))
        self.evidence = evidence
        per_artifact = materialize(self.keyed.filter(F.col("artifact_id").isNotNull()).groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n")), "artifacts")
        self.heavy_artifacts = heavy_keys(per_artifact, ["artifact_id"], "n", self.texts.total)

    def misjudged(self) -> DataFrame:
        """doc_id of documents with a recorded count below half or above twice their tokens."""
        recorded = self.evidence.filter(F.col("token_count").isNotNull() & F.col("artifact_id").isNotNull()).groupBy("artifact_id").agg(F.min("token_count").alias("low"), F.max("token_count").alias("high"))
        documents = salted_join(self.keyed.select("doc_id", "artifact_id", *KEY), recorded, ["artifact_id"], self.heavy_artifacts, F.col("doc_id"))
        counted = salted_join(documents, self.tokens, KEY, self.texts.heavy, F.col("doc_id"))
        return counted.filter((F.col("low") * 2 < F.col("tokens")) | (F.col("high") > F.col("tokens") * 2)).select("doc_id").distinct()

    def totals(self) -> DataFrame:
        """source, language, domain, documents, tokens."""
        filled = lambda c: F.max(F.when(F.trim(c) != "", F.trim(c)))
        known = self.evidence.filter(F.col("artifact_id").isNotNull()).groupBy("artifact_id").agg(filled("source_guess").alias("source_guess"), filled("owner_email").alias("evidence_owner"))
        described = salted_join(self.keyed, known, ["artifact_id"], self.heavy_artifacts, F.col("doc_id"), "left")
        owner = F.coalesce(F.when(F.trim("owner_email") != "", F.col("owner_email")), F.col("evidence_owner"))
        slices = (
            described.groupBy(*KEY, canonical(F.col("source_guess")).alias("source"), F.coalesce(F.lower(F.trim("lang")), F.lit("(none)")).alias("language"), mail_domain(owner).alias("domain"))
            .agg(F.count(F.lit(1)).alias("times"))
        )
        counted = salted_join(slices, self.tokens, KEY, self.texts.heavy, F.struct("source", "language", "domain"))
        return counted.groupBy("source", "language", "domain").agg(F.sum("times").alias("documents"), F.sum(F.col("times") * F.col("tokens")).alias("tokens"))
