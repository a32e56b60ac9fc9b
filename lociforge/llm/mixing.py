"""Mixing sources to target weights by weighted fair queueing.

The documents of each source queue up in a shuffled order, pass after pass. A document's virtual
finish time is the number of its source's words up to its end, divided by the source's weight. All
queues are range-sorted by it into one, and the sorted queue is cut where the total budget is spent:
at a virtual time, a source has been served its weight times that, or all it has. The document
being served at the cut contributes its words up to there.

Cumulative words of a source come from totals of 4096 slots of the shuffled order, so a hot source
is spread over as many tasks. Windows without a key see a row per source or per slice only.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociforge.llm.store import materialise

WORD = r"[^\x20\x09-\x0D]+"
SLOTS = 4096
SEED = 17


def words_in(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """``source, weight``: sources by code point, null last, take the weights in turn."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return sizes.select("source").distinct().select("source", F.get(weights, turn % len(cycle)).alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, share: float, repeats: int) -> DataFrame:
    """``source, weight, source_size, cap, target, budget``: a share of all words divided by weight.

    No target is above ``repeats`` times its source's size; what that leaves goes to the others by
    weight. With sources in the order of cap / weight, the water level is the largest of (budget -
    caps before) / (weights from here on). A row a source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = total.join(weights.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("cap", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumn("budget", F.lit(share) * F.sum("source_size").over(whole))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    rows = rows.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole))
    reach = F.least(F.col("cap").cast("double"), F.col("_level") * F.col("weight"))
    return rows.select("source", "weight", "source_size", "cap", reach.alias("target"), "budget")


def queues(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text_hash, source, size) with the source's plan and ``ahead``, the words before each in its shuffled source."""
    order = F.xxhash64("doc_id", "text_hash", F.lit(SEED))
    rows = docs.withColumn("_order", order).withColumn("_slot", F.shiftrightunsigned("_order", 52).cast("int"))
    slots = rows.groupBy("source", "_slot").agg(F.sum("size").alias("_n"))
    below = Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(
        F.col("source").alias("_source"), F.col("_slot").alias("_place"), F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below")
    )
    slots = slots.join(plan, F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    rows = rows.join(slots, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slot") == F.col("_place")))
    inner = Window.partitionBy("source", "_slot").orderBy("_order", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_below") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    return rows.withColumn("ahead", ahead).drop("_order", "_slot", "_source", "_place", "_below")


def finish_times(queued: DataFrame, repeats: int) -> DataFrame:
    """``doc_id, text_hash, source, weight, cap, size, copy, begin, finish`` of every pass: begin in words, finish in virtual time."""
    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    begin = F.col("copy") * F.col("source_size") + F.col("ahead")
    return copies.select(
        "doc_id", "text_hash", "source", "weight", "cap", "size", "copy", begin.alias("begin"),
        ((begin + F.col("size")) / F.col("weight")).alias("finish"),
    )


def global_order(queue: DataFrame) -> DataFrame:
    """The queue range-sorted by finish time, with its ``slice``, written out as the sort's sampling is not repeatable."""
    keys = ["finish", F.col("source").asc_nulls_last(), "copy", "doc_id", "text_hash"]
    ordered = queue.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialise(ordered.withColumn("slice", F.spark_partition_id()), "queue")


def cut_time(ordered: DataFrame, budget: float) -> float:
    """The virtual time at which the sorted queue has served the budget; infinite if it never does.

    A source leaves when its last document is done. At a finish time, those gone have been served
    their caps and the others their weight times the time. Sums per slice find the slice in which the budget
    runs out, and a window over that slice alone finds the place.
    """
    gone = (F.col("begin") + F.col("size") == F.col("cap")) & (F.col("size") > 0)
    rows = ordered.select(
        "slice", "finish", "copy", "doc_id", "text_hash", "source",
        F.when(gone, F.col("weight")).otherwise(0.0).alias("w"), F.when(gone, F.col("cap")).otherwise(0).alias("c"),
    )
    slices = rows.groupBy("slice").agg(F.sum("w").alias("w"), F.sum("c").alias("c"), F.max("finish").alias("finish"))
    running = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    slices = slices.select(
        "slice", "finish", (F.sum("w").over(running)).alias("gone_w"), F.sum("c").over(running).alias("gone_c"),
        F.sum("w").over(whole).alias("all_w"), "w", "c",
    )
    served = F.col("finish") * (F.col("all_w") - F.col("gone_w")) + F.col("gone_c")
    cut = slices.filter(served >= budget).orderBy("slice").first()
    if cut is None:
        return float("inf")
    order = Window.partitionBy("slice").orderBy("finish", F.col("source").asc_nulls_last(), "copy", "doc_id", "text_hash")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    active = F.lit(cut["all_w"] - cut["gone_w"] + cut["w"]) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    done = F.lit(cut["gone_c"] - cut["c"]) + F.coalesce(F.sum("c").over(before), F.lit(0))
    inside = rows.filter(F.col("slice") == cut["slice"]).withColumn("active", active).withColumn("done", done)
    inside = inside.filter(F.col("active") * F.col("finish") + F.col("done") >= budget)
    found = inside.agg(F.min_by((F.lit(budget) - F.col("done")) / F.col("active"), F.struct("finish", F.col("done"))).alias("t")).first()
    return float("inf") if found["t"] is None else found["t"]


def served(begin: Column, size: Column, weight: Column, time: float) -> Column:
    """Words of a document served by a virtual time."""
    if time == float("inf"):
        return size
    left = F.floor(weight * F.lit(time) - begin + F.lit(1e-6)).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(size, left))


def mix(
    docs: DataFrame, share: float = 1.5, repeats: int = 2, weights: DataFrame | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The mix of a table: its documents and its queue.

    Documents: ``doc_id, text_hash, source, size, source_size, target, taken``; taken counts repeats. Queue: ``doc_id,
    text_hash, source, copy, finish, words``, a row for each copy that the mix takes, in order of ``slice`` and
    finish. Without ``weights`` (``source, weight``) sources weigh 3, 1, 2 in turn. Null text has
    no words, a null source is one like any other and the last; documents without words are taken
    with none. Rows equal in id, source and text are documents of their own. Reruns agree. An empty
    table gives no rows.
    """
    text = F.col(text_col)
    sizes = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(source_col).alias("source"),
        words_in(text).alias("size"),
    )
    sizes = materialise(sizes, "sizes")
    plan = targets(sizes, cyclic_weights(sizes) if weights is None else weights, share, repeats)
    plan = materialise(plan, "targets")
    budget = plan.select("budget").first()
    queued = materialise(queues(sizes, plan), "queued")
    ordered = global_order(finish_times(queued, repeats))
    time = cut_time(ordered, budget[0]) if budget else 0.0
    taken = F.lit(0).cast("long")
    for copy in range(repeats):
        begin = F.col("ahead") + F.lit(copy) * F.col("source_size")
        taken = taken + served(begin, F.col("size"), F.col("weight"), time)
    found = queued.select("doc_id", "text_hash", "source", "size", "source_size", "target", taken.alias("taken"))
    words = served(F.col("begin"), F.col("size"), F.col("weight"), time)
    queue = ordered.select("slice", "finish", "doc_id", "text_hash", "source", "copy", words.alias("words")).filter("words > 0")
    return found, queue


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    word = re.compile(WORD)

    @F.arrow_udf("string")
    def values(texts: pa.Array, counts: pa.Array) -> pa.Array:
        out = []
        for value, count in zip(texts.to_pylist(), counts.to_pylist()):
            end = 0
            for k, m in enumerate(word.finditer(value), 1):
                end = m.end()
                if k >= count:
                    break
            out.append(value[:end])
        return pa.array(out, pa.string())

    return values(text, n)


def mixed_documents(docs: DataFrame, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; a part taken is its first words.

    Keeps the columns; ``n_chars``, if there is one, follows the text. Texts without words are left out.
    Rows equal in id, source and text are taken together: their words are added up.
    """
    found, _ = mix(docs, share, repeats)
    plan = (
        found.groupBy("doc_id", "text_hash", "source").agg(F.max("size").alias("size"), F.sum("taken").alias("taken"))
        .filter("taken > 0").withColumnsRenamed({"doc_id": "plan_id", "text_hash": "plan_hash", "source": "plan_source"})
    )
    rows = docs.select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col("source").alias("origin"), F.struct("*").alias("row")
    )
    same = (
        F.col("id").eqNullSafe(F.col("plan_id")) & (F.col("hash") == F.col("plan_hash"))
        & F.col("origin").eqNullSafe(F.col("plan_source"))
    )
    rows = rows.join(plan, same).dropDuplicates(["id", "hash", "origin"])
    whole = rows.withColumn("n", F.expr("cast(taken div size as int)")).filter("n > 0")
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
    text = first_words(F.col("row.text"), F.expr("taken % size"))
    part = rows.filter("taken % size > 0").select(F.col("row").withField("text", text).alias("row"))
    if "n_chars" in docs.columns:
        length = F.length("row.text").cast(docs.schema["n_chars"].dataType)
        part = part.select(F.col("row").withField("n_chars", length).alias("row"))
    return whole.unionByName(part.select("row.*"))
