"""Operator 9: SpotSigs fingerprints, in built-in DataFrame functions only.

A text is split into lower-case words.  Every common word is an anchor; its
spot signature is the anchor with the chain of the next ``CHAIN`` content words
(words that are not common).  The distinct signature hashes, sorted, are the
fingerprint; likeness is their Jaccard value.  ``pruned_jaccard`` first
compares set lengths: sets whose lengths lie in partitions that are not
neighbours can't reach the threshold and are not intersected.

A text without anchors takes a chain at every word; a text without words takes
the text itself as its only signature, so no fingerprint is empty.

The likeness of given pairs is exact; whether they are near (``NEAR`` or more) is
asked of the length partitions first, and only pairs in the same or
neighbouring ones are intersected for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_table, whole_text

# Common words of English, French, German and Spanish.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "by", "be", "at",
    "from", "this", "are", "an", "or", "not", "have", "he", "she", "they", "we", "you", "his", "her", "which",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "en", "que", "qui", "dans", "pour", "pas",
    "sur", "par", "au", "avec", "il", "elle", "ce",
    "der", "die", "das", "und", "ist", "von", "den", "mit", "zu", "sich", "dem", "für", "nicht", "ein", "eine",
    "im", "auf", "auch", "es",
    "el", "los", "las", "y", "se", "del", "una", "su", "al", "con", "no", "por", "para", "lo", "como",
)
#: Content words in a chain.
CHAIN = 2
#: Likeness that the length partitions are made for.
NEAR = 0.8
#: Ranges of ids that are ordered apart from each other: so many for each
#: shuffle partition, that partitions which get ranges by hash are alike.
RANGES, MOST_RANGES = 16, 16_384


def words(text: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def with_signatures(df: DataFrame, text_col: str, out_col: str, *, common: tuple[str, ...] = COMMON_WORDS,
                    chain: int = CHAIN) -> DataFrame:
    """``df`` with the sorted distinct signature hashes (array of int) of a text column.

    Steps are columns of their own, so each is computed once per row.
    """
    w, content, anchors = f"{out_col}__w", f"{out_col}__c", f"{out_col}__a"
    chosen = list(common)
    df = df.withColumn(w, words(F.col(text_col)))
    df = (df.withColumn(content, F.filter(F.col(w), lambda x: ~x.isin(chosen)))
            .withColumn(anchors, F.filter(F.transform(F.col(w), lambda x, i: F.when(x.isin(chosen), i).otherwise(-1)),
                                          lambda i: i >= 0)))
    # before the k-th anchor, at word i, there are i - k content words
    spots = F.transform(F.col(anchors), lambda i, k: F.hash(
        F.get(F.col(w), i), *[F.get(F.col(content), i - k + j) for j in range(chain)]))
    plain = F.transform(F.col(w), lambda x, i: F.hash(x, *[F.get(F.col(w), i + j) for j in range(1, chain + 1)]))
    sigs = (F.when(F.size(anchors) > 0, spots).when(F.size(w) > 0, plain).otherwise(F.array(F.hash(F.col(text_col)))))
    return df.withColumn(out_col, F.array_sort(F.array_distinct(sigs))).drop(w, content, anchors)


def fingerprint(signatures: str) -> Column:
    """Signature hashes as one string."""
    return F.concat_ws(",", F.col(signatures).cast("array<string>"))


def length_partition(signatures: Column, threshold: float) -> Column:
    """Partition of a set by its length: sets that reach ``threshold`` lie in the same or neighbouring partitions."""
    return F.floor(F.log(F.size(signatures).cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9))


def pruned_jaccard(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard value of two signature sets; 0 without intersecting them if
    their lengths rule out ``threshold`` (0: nothing is pruned)."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    value = shared / (F.size(a) + F.size(b) - shared)
    if threshold <= 0:
        return value
    near = F.abs(length_partition(a, threshold) - length_partition(b, threshold)) <= 1
    return F.when(near, value).otherwise(0.0)


def not_above(cuts: list, x: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``x``: first among blocks of
    cuts, then inside the one block, so a row costs the root of their number."""
    if not cuts:
        return F.lit(0)
    size = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i: i + size] for i in range(0, len(cuts), size)]
    full = F.size(F.filter(F.lit([b[0] for b in blocks]), lambda c: c <= x)) - 1
    inside = F.size(F.filter(F.get(F.array(*map(F.lit, blocks)), F.greatest(full, F.lit(0))), lambda c: c <= x))
    return F.when(full < 0, 0).otherwise(full * size + inside)


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, ``text``, ``sigs``, ``next_text``, ``next_sigs``: the next
    document by descending id (nulls last; equal ids by text); after the last
    comes the first.

    Ids are cut into equal ranges by approximate quantiles, ``RANGES`` for each
    shuffle partition (``MOST_RANGES`` at most: more data make longer ranges,
    which sort with spilling), and each range also gets the first row of the
    range after it.  The texts are shuffled once, and no task orders more than its
    range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    n = max(1, min(MOST_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n))).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.when(F.col("id").isNull(), len(cuts) + 1).otherwise(len(cuts) - not_above(cuts, F.col("id")))
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("last", F.lit(False))
    # one row per range: its first id and the range before it
    around = Window.orderBy("bucket")
    heads = scratch_table(rows.groupBy("bucket").agg(F.max("id").alias("top")))
    heads = heads.withColumn("to", F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(Window.partitionBy())))
    heads = scratch_table(heads)                       # its known size decides how it is joined
    firsts = (rows.join(heads, "bucket").where(F.col("id").eqNullSafe(F.col("top")))
              .groupBy("to").agg(F.max("id").alias("id"), F.min("text").alias("text")))
    closing = firsts.select("id", "text", F.col("to").alias("bucket"), F.lit(True).alias("last"))
    ranged = with_signatures(rows.unionByName(closing).repartition(F.col("bucket")), "text", "sigs")
    order = Window.partitionBy("bucket").orderBy("last", F.col("id").desc_nulls_last(), "text")
    return (ranged.withColumn("next_text", F.lead("text").over(order))
            .withColumn("next_sigs", F.lead("sigs").over(order))
            .where(~F.col("last")).drop("bucket", "last").withColumnRenamed("id", id_col))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``
    (exact), ``is_near_edited``, ``is_near_next`` (a likeness of ``NEAR`` or more,
    by pruned Jaccard), and ``length_partition``: fingerprints that are
    near lie in the same or a neighbouring one.

    The edited text is the text whose last half (rounded down) is replaced by
    as many code points from the start of the next document.  Null texts count
    as empty; repeated rows keep a row each; a single row is its own next; an
    empty table gives an empty result; further columns are ignored.
    """
    rows = with_next(docs, id_col=id_col, text_col=text_col)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half),
                                              F.substring(F.col("next_text"), F.lit(1), half))).drop("text", "next_text")
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(id_col, "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
                       fingerprint("sigs").alias("fingerprint"), fingerprint("edited_sigs").alias("edited_fingerprint"),
                       pruned_jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                       pruned_jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
                       (pruned_jaccard(F.col("sigs"), F.col("edited_sigs"), NEAR) >= NEAR).alias("is_near_edited"),
                       (pruned_jaccard(F.col("sigs"), F.col("next_sigs"), NEAR) >= NEAR).alias("is_near_next"),
                       length_partition(F.col("sigs"), NEAR).cast("int").alias("length_partition"))
