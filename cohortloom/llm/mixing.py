"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Documents get a uniform hash. Words are summed by source and leading hash bits; running sums over the buckets show
the one bucket in which a source's budget runs out, and only its documents are looked at again, by further bits. What
lies below the threshold found is taken by a plain comparison; nothing is sorted by document. Equal rows share a hash: of those
at the threshold itself, as many are taken as the rest of the budget holds, numbered part by part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.shared import documents, staged

# Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
# No document is taken more often than this.
MOST_REPEATS = 3
# Hash bits, and how many of them each histogram resolves.
BITS = 60
LEVELS = (12, 12, 36)
# Plans of at most so many sources are broadcast (under 1 MB); larger ones are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix_hash(doc_id: Column, text: Column) -> Column:
    """60 uniform bits of a document's id and text: equal rows share them, reruns agree."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text)))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target of (source, source_size) rows, one for each source.

    Weights follow the names by code point (null last). Targets share the sum of all sizes by weight but stop at `most`
    times the source's size; the excess is shared again among the rest until none is above. Closed form: in the
    order of size / weight, the sources that stop are a prefix, and the level of the rest is what remains over their weights.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    above = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(above)
    # Along that order the level rises while sources stop and falls afterwards: its maximum is the one that holds.
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return rows.select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below, extra): documents of a hash under `below` fit the source's budget of words together, and `extra` of those at it too.

    Each level keeps, per source, the last bucket edge within the budget, and what of the budget is left behind it.
    """
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    known = budgets.select("source", F.lit(0).cast("long").alias("below"), F.col("budget"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("extra"))
    open_rows, rest = rows, BITS
    for bits in LEVELS:
        rest -= bits
        width = 1 << rest
        span = F.lit(width << bits)
        if rest + bits < BITS:
            at_edge = same("d", "k") & (F.col("d.hash") >= F.col("k.below")) & (F.col("d.hash") < F.col("k.below") + span)
            open_rows = staged(open_rows.alias("d").join(known.where("NOT done").alias("k"), at_edge).select("d.source", "d.hash", "d.size"))
        sums = open_rows.groupBy("source", F.expr(f"hash div {width}").alias("bucket")).agg(F.sum("size").alias("n"), F.max("size").alias("most"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("n").over(running))
        over = (
            sums.alias("s").join(known.alias("k"), same("s", "k")).where(F.col("s.upto") > F.col("k.budget"))
            .groupBy(F.col("k.source").alias("source")).agg(F.min("bucket").alias("bucket"), F.min(F.col("s.upto") - F.col("s.n")).alias("spent"), F.min_by("s.most", "bucket").alias("most"))
        )
        # A source all of whose documents fit is done: its threshold is the end of the bucket looked at.
        # The last buckets hold one hash each, whose rows are of one size.
        found = F.col("o.bucket").isNotNull()
        left = F.col("k.budget") - F.col("o.spent")
        known = staged(
            known.alias("k").join(over.alias("o"), same("k", "o"), "left").select(
                F.col("k.source").alias("source"),
                F.when(F.col("k.done"), F.col("k.below")).when(found, F.col("o.bucket") * F.lit(width)).otherwise(F.col("k.below") + span).alias("below"),
                F.when(found, left).otherwise(F.col("k.budget")).alias("budget"),
                (F.col("k.done") | ~found).alias("done"),
                F.when(found & F.lit(rest == 0), F.floor(left / F.col("o.most"))).otherwise(F.lit(0)).cast("long").alias("extra"),
            )
        )
    return known.select("source", "below", "extra")


def mix_plan(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target, whole, below, extra of staged (source, size, hash) rows: a document is taken `whole` times, and once more
    (never above `most`) if its hash lies under `below` or it is one of `extra` rows at it. One row per source."""
    plan = staged(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", F.least(whole, F.lit(most)).cast("long"))
    budgets = plan.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    edges = _thresholds(slim, budgets)
    return staged(plan.alias("p").join(edges.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source"))).select("p.*", "e.below", "e.extra"))


def with_plan(rows: DataFrame, plan: DataFrame, source: str, hashed: str, most: int = MOST_REPEATS) -> DataFrame:
    """rows joined with their source's plan as p_size, p_target, p_repeats. The plan is broadcast only if it is known to be small.

    Only where equal rows stand at a threshold are those staged and numbered within their task's part, behind the rows of the parts before.
    """
    split = not plan.where("extra > 0").isEmpty()
    plan = plan.select(*(F.col(c).alias(f"p_{c}") for c in plan.columns))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rows = rows.join(plan, F.col(source).eqNullSafe(F.col("p_source")))
    once_more = F.col(hashed) < F.col("p_below")
    if split:
        at_edge = (F.col(hashed) == F.col("p_below")) & (F.col("p_extra") > 0)
        edge = staged(rows.where(at_edge).withColumn("p_part", F.spark_partition_id()))
        before = Window.partitionBy("p_source").orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = edge.groupBy("p_source", "p_part").agg(F.count("*").alias("n")).select(
            F.col("p_source").alias("e_source"), F.col("p_part").alias("e_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("e_before"))
        number = F.row_number().over(Window.partitionBy("p_source", "p_part").orderBy(hashed))
        edge = edge.withColumn("p_number", number).join(parts, F.col("p_source").eqNullSafe(F.col("e_source")) & (F.col("p_part") == F.col("e_part")))
        edge = edge.withColumn("p_more", F.col("e_before") + F.col("p_number") <= F.col("p_extra")).drop("p_part", "p_number", "e_source", "e_part", "e_before")
        rows = rows.where(~at_edge).withColumn("p_more", once_more).unionByName(edge)
    else:
        rows = rows.withColumn("p_more", once_more)
    once_more = F.col("p_more").cast("int")
    return rows.withColumn("p_repeats", F.least(F.col("p_whole") + once_more, F.lit(most)).cast("long"))


def _slim(docs: DataFrame) -> DataFrame:
    return documents(docs, "source").select(
        "doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), mix_hash(F.col("doc_id"), F.col("text")).alias("hash")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes: size times the repeats), repeats.

    A source gets every document as often as its target holds its size, and of the rest, by hash, the documents whose
    words fit: the words taken fall short of the target by less than one document (of equal rows, which share a hash, as many
    are taken as fit). Null or empty texts have size 0 and cost
    nothing; a source without words has target 0. Null sources form one source, after all others; its weight is the next one.
    An empty table gives an empty result.
    """
    slim = staged(_slim(docs))
    rows = with_plan(slim, mix_plan(slim, weights, most), "source", "hash", most)
    return rows.select(
        "doc_id", "source", "size", F.col("p_source_size").alias("source_size"), F.col("p_target").alias("target"),
        (F.col("size") * F.col("p_repeats")).alias("taken"), F.col("p_repeats").alias("repeats"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The mix itself: the rows of docs with all their columns, each as often as it is taken. Texts are not shuffled."""
    plan = mix_plan(staged(_slim(docs)), weights, most)
    own = {c: f"d_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*own.values())
    rows = rows.withColumn("m_source", F.col(own["source"]).cast("string")).withColumn(
        "m_hash", mix_hash(F.col(own["doc_id"]).cast("long"), F.coalesce(F.col(own["text"]), F.lit(""))))
    rows = with_plan(rows, plan, "m_source", "m_hash", most).where("p_repeats > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("p_repeats"))))
    return rows.select(*(F.col(new).alias(old) for old, new in own.items()))
