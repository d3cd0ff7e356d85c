"""Token counts: the exact histogram of encoded lengths and what suffix sums over it answer for every context limit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.shared import documents, send_code, staged
from cohortloom.llm.tokens import default_tokenizer, encoder, slices, texts_of

# Lengths that one task sums at a time.
SPAN = 4096


def token_lengths(docs: DataFrame, tokenizer: str | None = None, end_tokens: int = 0) -> DataFrame:
    """doc_id, n_tokens of every whole text (null: empty) plus end_tokens."""
    path = tokenizer or default_tokenizer()
    send_code(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches):
            lengths = [len(ids) + end_tokens for ids in encode.encode_many(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"])

    return documents(docs).mapInArrow(count, "doc_id long, n_tokens long")


def length_table(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """One row per encoded length that occurs, which as a context limit answers:

    n_docs (of this length), docs_longer, tokens_longer (suffix sums behind it), docs_upto, tokens_upto, docs_total, tokens_total,
    truncated_total (tokens left when every document is cut to this length), share_upto (share of documents of this length or less: the length
    is the quantile of that level). Rows with a null length are left out. Empty input: empty result.

    Sums run per span of lengths and over the spans' totals, so no task sees more than one span or one row per span.
    """
    histogram = staged(lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("length")).agg(F.count("*").alias("n_docs")))
    histogram = histogram.withColumn("span", F.expr(f"length div {SPAN}"))
    spans = histogram.groupBy("span").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("length")).alias("tokens"))
    behind = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    spans = spans.select(
        "span", F.coalesce(F.sum("docs").over(behind), zero).alias("docs_behind"), F.coalesce(F.sum("tokens").over(behind), zero).alias("tokens_behind"),
        F.sum("docs").over(everything).alias("docs_total"), F.sum("tokens").over(everything).alias("tokens_total"),
    )
    longer = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    rows = histogram.join(spans, "span").select(
        "length", "n_docs", "docs_total", "tokens_total",
        (F.col("docs_behind") + F.coalesce(F.sum("n_docs").over(longer), zero)).alias("docs_longer"),
        (F.col("tokens_behind") + F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(longer), zero)).alias("tokens_longer"),
    )
    return rows.select(
        "length", "n_docs", "docs_longer", "tokens_longer", (F.col("docs_total") - F.col("docs_longer")).alias("docs_upto"),
        (F.col("tokens_total") - F.col("tokens_longer")).alias("tokens_upto"), "docs_total", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col("length")).alias("truncated_total"),
        ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("share_upto"),
    )


def at_limits(answers: DataFrame, limits: Sequence[int]) -> DataFrame:
    """limit, docs_upto, tokens_upto, truncated_total, share_upto for the given context limits, of length_table() rows.

    One pass over the table with a few sums for each limit. Of an empty table the counts are 0 and the share is null.
    """
    rows = sorted({int(limit) for limit in limits})
    n, tokens, length = F.col("n_docs"), F.col("n_docs") * F.col("length"), F.col("length")

    def upto(limit: int, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(length <= limit, value)), F.lit(0))

    answer = [
        F.struct(
            F.lit(limit).cast("long").alias("limit"), upto(limit, n).alias("docs_upto"), upto(limit, tokens).alias("tokens_upto"),
            F.coalesce(F.sum(n * F.least(length, F.lit(limit))), F.lit(0)).alias("truncated_total"),
            F.try_divide(upto(limit, n), F.sum(n)).alias("share_upto"),
        )
        for limit in rows
    ]
    return answers.agg(F.array(*answer).alias("answers")).select(F.inline("answers"))
