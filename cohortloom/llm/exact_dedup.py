"""Exact duplicates by content-defined chunk recipes. DataFrame functions only.

A text without white space is cut where its own content says so, so a text's cuts depend on nothing else. Each chunk
becomes a 64-bit identifier and a document the ordered list of its identifiers (its recipe). Identifiers are verified
against the chunks' SHA-256 over the whole table; should one stand for two contents, those contents get identifiers
of their own. Equal texts then are equal recipes: only lists of a few bytes per kilobyte travel, never the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import documents, staged, without_spaces

# A chunk ends behind one of these runs of characters once it has LEAST characters (about 500 on average in prose), and at MOST in any case:
# text in which no such run occurs is cut by length.
ENDS = "[aiou0-4][nhvz5-9][et][hrs][aeo0-9][nlrs0-9]|[^\\x00-\\x7f][aeo][^\\x00-\\x7f]"
LEAST, MOST = 64, 4096
CHUNK = f"(?s).{{{LEAST},{MOST - 6}}}?(?:{ENDS})|.{{1,{MOST}}}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_points, text_sha256 of the normalised text, and its chunks as (id, sha) in order."""
    rows = documents(docs).select("doc_id", F.char_length("text").alias("n_points"), F.xxhash64("text").alias("text_hash"), without_spaces(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", "n_points", "text_hash", F.sha2(F.encode("norm", "utf-8"), 256).alias("text_sha256"), chunks(F.col("norm")).alias("parts"))
    part = lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(F.encode(c, "utf-8"), 256)).alias("sha"))
    return rows.select("doc_id", "n_points", "text_hash", "text_sha256", F.transform("parts", part).alias("parts"))


def verified(rows: DataFrame) -> DataFrame:
    """Rows with `recipe`, the list of identifiers, each of which stands for one content only."""
    distinct = rows.select(F.explode("parts").alias("p")).select("p.id", "p.sha").groupBy("id", "sha").agg(F.count("*").alias("uses"))
    shared = staged(distinct.groupBy("id").agg(F.count("*").alias("contents")).where("contents > 1").select("id"))
    recipe = F.transform("parts", lambda p: p["id"])
    if shared.isEmpty():
        return rows.select("doc_id", "n_points", "text_hash", "text_sha256", recipe.alias("recipe"))
    # One row per document that uses an identifier of several contents; those take the digest into their recipe.
    rows = rows.withColumn("plain", recipe)
    used = rows.select("plain", F.explode("plain").alias("id")).join(shared, "id", "left_semi").select("plain").distinct().withColumn("clash", F.lit(True))
    finer = F.transform("parts", lambda p: F.xxhash64(p["id"], p["sha"]))
    rows = rows.join(used, "plain", "left")
    return rows.select(
        "doc_id", "n_points", "text_hash", "text_sha256",
        F.when(F.col("clash"), F.concat(F.array(F.lit(0).cast("long")), finer)).otherwise(F.col("plain")).alias("recipe"),
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when they are after deleting white space; null counts as empty, and empty texts are equal. The row with the most
    code points in the original text stays, then the smallest doc_id (null ids last). Of rows that repeat a
    whole (id and length), each is marked kept, as nothing tells them apart. Empty table: empty result.
    """
    rows = verified(staged(recipes(docs)))
    longest = rows.groupBy("recipe").agg(F.max("n_points").alias("most"), F.count("*").alias("group_size"))
    of_length = rows.groupBy("recipe", "n_points").agg(F.min("doc_id").alias("keep_id"))
    groups = longest.alias("l").join(of_length.alias("o"), (F.col("l.recipe") == F.col("o.recipe")) & (F.col("l.most") == F.col("o.n_points"))).select(
        F.col("l.recipe").alias("recipe"), "most", "group_size", "keep_id"
    )
    return rows.join(groups, "recipe").select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("most"))).alias("kept"),
        "text_sha256", F.size("recipe").alias("n_chunks"), "n_points", "text_hash",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; one of each group.

    Kept rows of a group share id and length; of those with other white space, the one with the smallest hash of the text stays, and of those with the same text
    the one whose columns come first in order: the result is the same in every run. An empty table stays empty.
    """
    kept = exact_groups(docs).where("kept").groupBy("text_sha256", F.col("doc_id").alias("s_id"), F.col("n_points").alias("s_points"))
    stay = kept.agg(F.min("text_hash").alias("s_hash"))
    own = {c: f"d_{i}" for i, c in enumerate(docs.columns)}
    text = F.coalesce(F.col(own["text"]), F.lit(""))
    rows = docs.toDF(*own.values())
    rows = rows.withColumns({"r_id": F.coalesce(F.col(own["doc_id"]).cast("long"), F.lit(0)), "r_null": F.col(own["doc_id"]).isNull(), "r_points": F.char_length(text), "r_hash": F.xxhash64(text)})
    stay = stay.select(F.coalesce("s_id", F.lit(0)).alias("r_id"), F.col("s_id").isNull().alias("r_null"), F.col("s_points").alias("r_points"), F.col("s_hash").alias("r_hash"))
    key = ["r_id", "r_null", "r_points", "r_hash"]
    rows = rows.join(stay, key, "left_semi").groupBy(*key).agg(F.min(F.struct(*own.values())).alias("row"))
    return rows.select(*(F.col(f"row.{new}").alias(old) for old, new in own.items()))
