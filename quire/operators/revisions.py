"""What changed between two revisions of a document's objects, and whether that was allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: kinds of change as bits, least significant use first
SIGNATURES, FORM_FIELDS, ANNOTATIONS, METADATA, OTHER, VALIDATION_DATA, TIMESTAMP = 1, 2, 4, 8, 16, 32, 64
ALWAYS_ALLOWED = VALIDATION_DATA | TIMESTAMP
# ------------------------------------------------------------------------


def revision_diff(before: DataFrame, after: DataFrame, uses: DataFrame) -> DataFrame:
    """Objects `(doc_id, obj_id, hash)` that are new, changed or freed, with their most significant use.

    `uses (doc_id, obj_id, flag)` says where either revision uses an object; one used nowhere known counts
    as any other change.
    """
    key = ["doc_id", "obj_id"]
    both = before.select(*key, F.col("hash").alias("_b")).join(after.select(*key, F.col("hash").alias("_a")), key, "full_outer")
    changed = both.where(~F.col("_b").eqNullSafe(F.col("_a")))
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "freed").otherwise("changed")
    # Content outweighs every other use; validation data and timestamps weigh least.
    weight = F.when(F.col("flag").isin(VALIDATION_DATA, TIMESTAMP), -F.col("flag")).otherwise(F.col("flag"))
    top = uses.groupBy(*key).agg(F.max_by("flag", weight).alias("flag"))
    return changed.join(top, key, "left").select(*key, change.alias("change"), F.coalesce("flag", F.lit(OTHER)).alias("flag"))


def change_flags(diff: DataFrame) -> DataFrame:
    """All kinds of change of a document as one bit mask."""
    return diff.groupBy("doc_id").agg(F.bit_or("flag").alias("changes"), F.count(F.lit(1)).alias("objects"))


def verdict(docs: DataFrame) -> DataFrame:
    """What `(integrity, changes, level, lock_broken, unverifiable)` means for a signed document.

    Level 1 permits nothing, 2 filling and signing, 3 or none also comments.
    """
    real = F.col("changes").bitwiseAND(~ALWAYS_ALLOWED & 0xFFFF)
    permitted = (real.bitwiseAND(OTHER) == 0) & F.when(F.col("level") == 1, False).when(F.col("level") == 2, real.bitwiseAND(ANNOTATIONS) == 0).otherwise(True)
    answer = (
        F.when(~F.col("integrity"), "Invalid").when(real == 0, "Valid")
        .when(F.col("unverifiable") | F.col("lock_broken"), "ModifiedAfterSigning")
        .when(permitted, "ValidWithPermittedChanges").otherwise("ModifiedAfterSigning")
    )
    return docs.withColumn("verdict", answer)
