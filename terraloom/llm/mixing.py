"""Mixing sources to target weights by Pareto order sampling.

``targets`` turns source weights into words: shares by weight, each held at
``max_epochs`` times what its source has, the excess reshared by weight
(water filling, in closed form). Within a source a document's expected copies
are its odds times one factor per source, at most ``max_epochs``; the factor
makes the words add up to the target (water filling again, over the source's
distinct odds, which are rounded to eighths of a power of two, so they are few).
``mix`` gives every document the whole copies that its expected count makes
certain and draws the rest by Pareto order sampling: with ``u`` uniform per
document and ``p`` its own inclusion probability, documents rank by
``u/(1-u) / (p/(1-p))``, and the first ones are taken until one doesn't fit
the source's remaining words. That one is
passed over, and so on through all later ranks: whatever still fits is taken.
This goes by turns of ``FILL`` ranks put in order and a search, by slices, for
the next rank that doesn't fit, until none fits. The sample's size is thus
fixed in words. Of the documents left, the one whose size comes nearest to
what is still missing closes the gap.

The uniform numbers come from md5 of seed and document, so reruns agree. A
source is never brought together in one task: documents are counted by slice
of their rank (``SLICES`` slices, then as many slices of the slice where the
target falls), and only that last slice is put in order. No collect.

Defined results: null text has size 0; null sources form a source of their
own, last in order; documents of size 0 get their whole copies and no draw;
odds that are null, zero or negative count as the smallest there are; equal ranks order by doc_id, then size; repeated rows are drawn
together or not at all; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terraloom.llm.common import WORD, store

SLICES = 4096
UNIT = 1 << 52
FILL = 64  #: ranks put in order at once after one that doesn't fit


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space, counted without building them."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.regexp_replace(squeezed, r"[^w]+", "")).cast("long")


def targets(sizes: DataFrame, max_epochs: int = 3, cycle: int = 3) -> DataFrame:
    """Per source of ``sizes`` (source, size): source_size and target.

    Sources by code point, null last, weigh 1, 2, ... ``cycle``, repeating.
    Windows here span one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(cycle)) + 1).cast("long"))
    per = per.withColumn("most", F.col("source_size") * max_epochs)
    # Sources that reach their limit first come first; the level is set by the first set of them that holds.
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = (
        per.withColumn("_free", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("_open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_level", F.col("_free") / F.col("_open"))
    )
    per = per.withColumn("_nth", F.row_number().over(full))
    level = F.min(F.when(F.col("_level") <= F.col("most") / F.col("weight"), F.struct("_nth", "_level"))).over(every)["_level"]
    held = F.least(F.col("most").cast("double"), F.col("weight") * F.col("_at"))
    return per.withColumn("_at", level).select("source", "source_size", F.coalesce(held, F.col("most").cast("double")).alias("target"))


def by_length() -> Column:
    """Odds that grow slowly with a document's words: of two, the longer one is likelier to come again."""
    return F.log2(F.col("size") + 2)


def _rounded(odds: Column) -> Column:
    """Odds as powers of two in steps of an eighth, between 2**-30 and 2**30."""
    eighths = F.round(8 * F.log2(F.when(odds > 0, odds)))
    return F.pow(F.lit(2.0), F.least(F.greatest(F.coalesce(eighths, F.lit(-240.0)), F.lit(-240.0)), F.lit(240.0)) / 8)


def factors(sizes: DataFrame, plan: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Per source of ``sizes`` (source, size, odds), the factor that turns odds into expected copies.

    ``plan`` (_source, target). The window spans a source's distinct odds, 481 at most.
    """
    per = sizes.groupBy("source", "_odds").agg(F.sum("size").alias("_s"))
    per = per.join(plan, per["source"].eqNullSafe(plan["_source"]))
    down = Window.partitionBy("source").orderBy(F.desc("_odds"))
    full = F.coalesce(F.sum("_s").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("_odds") * F.col("_s")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("_f", (F.col("target") - max_epochs * full) / F.nullif(rest, F.lit(0.0)))
    ok = F.col("_f") * F.col("_odds") <= max_epochs * (1 + 1e-12)
    return per.groupBy(F.col("source").alias("_source")).agg(F.max_by("_f", F.when(ok, F.col("_odds"))).alias("_factor"))


def rank_key(seed: str, doc: Column, share: Column) -> Column:
    """Random odds over inclusion odds; +inf where nothing is to be drawn."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(UNIT) + 1)
    odds = F.when((share > 0) & (share < 1), share / (1 - share))
    return (u / (1 - u)) / odds


def _filled(rows: DataFrame, slice_of: Column) -> DataFrame:
    """Per source the slice in which the words run out, and the words before it."""
    sums = rows.groupBy("source", slice_of.alias("_slice")).agg(F.sum("words").alias("_words"), F.max("_left").alias("_left"))
    run = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_upto", F.sum("_words").over(run))
    return sums.where(F.col("_upto") > F.col("_left")).groupBy(F.col("source").alias("_source")).agg(F.min("_slice").alias("_edge"), F.min_by(F.col("_upto") - F.col("_words"), "_slice").alias("_before"))


def mix(docs: DataFrame, seed: str = "mix", max_epochs: int = 3, odds: Column | str | None = None, slim: bool = False) -> DataFrame:
    """``docs`` (doc_id, source, text) with size, source_size, target, copies and taken.

    ``odds`` gives relative inclusion odds, as a column of ``docs`` or an
    expression that may use size (default: all alike); it shifts which
    documents come how often, not how many words. ``slim`` leaves out all
    columns of ``docs`` but doc_id and source.
    """
    own = ["size", "source_size", "target", "copies", "taken"]
    weight = F.lit(1.0) if odds is None else F.col(odds) if isinstance(odds, str) else odds
    docs = docs.select(*[c for c in docs.columns if c not in own]).withColumn("size", n_words(F.col("text")))
    small = store(docs.select("doc_id", "source", "size", _rounded(weight.cast("double")).alias("_odds")), "mix-sizes")
    plan = targets(small.select("source", "size"), max_epochs).withColumnRenamed("source", "_source")
    plan = store(plan, "mix-targets")
    found = factors(small, plan.select("_source", "target"), max_epochs).withColumnRenamed("_source", "_of")
    plan = store(plan.join(found, plan["_source"].eqNullSafe(found["_of"]), "left").drop("_of"), "mix-plan")

    def by_source(rows: DataFrame, per: DataFrame, how: str = "inner") -> DataFrame:
        """A row per source, stored beforehand, so Spark knows its size and sends it round if small."""
        return rows.join(per, rows["source"].eqNullSafe(per["_source"]), how).drop("_source")

    def expected(rows: DataFrame) -> DataFrame:
        """With _whole, the certain copies, and _share, the probability of one more."""
        copies = F.least(F.coalesce(F.col("_factor") * F.col("_odds"), F.lit(0.0)), F.lit(float(max_epochs)))
        rows = by_source(rows, plan).withColumn("_copies", copies).withColumn("_whole", F.floor(F.col("_copies") + 1e-9).cast("long"))
        return rows.withColumn("_share", F.greatest(F.col("_copies") - F.col("_whole"), F.lit(0.0))).drop("_copies", "_factor", "_odds")

    whole = expected(small).groupBy(F.col("source").alias("_source")).agg((F.max("target") - F.sum(F.col("_whole") * F.col("size"))).alias("_left"))
    whole = store(whole, "mix-left")

    def ranks(rows: DataFrame) -> DataFrame:
        return by_source(expected(rows), whole).withColumn("_key", rank_key(seed, F.col("doc_id"), F.col("_share")))

    me = F.struct("_key", "doc_id", "size")

    def first_over(rows: DataFrame) -> DataFrame:
        """Per source the first rank that no longer fits ``_left``, and the words still missing there; no row if all fit."""
        first = store(_filled(rows, F.floor(F.col("_place") / SLICES)), "mix-slice")
        inner = by_source(rows, first).where(F.floor(F.col("_place") / SLICES) == F.col("_edge")).withColumn("_left", F.col("_left") - F.col("_before")).drop("_edge", "_before")
        second = store(_filled(inner, F.col("_place")), "mix-slice")
        last = by_source(inner, second).where(F.col("_place") == F.col("_edge")).withColumn("_left", F.col("_left") - F.col("_before"))
        run = Window.partitionBy("source").orderBy(me).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        last = last.withColumn("_sum", F.sum("words").over(run))
        fits = F.col("_sum") <= F.col("_left")
        return store(last.groupBy(F.col("source").alias("_source")).agg(F.min(F.when(~fits, me)).alias("_edge"), (F.max("_left") - F.coalesce(F.max(F.when(fits, F.col("_sum"))), F.lit(0))).alias("_gap")), "mix-edge")

    # Repeated rows are one draw of all their words.
    draws = ranks(small).where(F.col("_key").isNotNull() & (F.col("size") > 0)).groupBy("source", "doc_id", "size", "_key", "_left").agg(F.sum("size").alias("words"))
    # ``words`` of a draw: of all rows that are alike.
    draws = store(draws.withColumn("_place", F.floor(F.col("_key") / (1 + F.col("_key")) * (SLICES * SLICES)).cast("long")), "mix-draws")
    fill = first_over(draws)
    at = f"struct<_key:double,doc_id:{small.schema['doc_id'].dataType.simpleString()},size:bigint>"
    fill = fill.withColumn("_at", F.col("_edge")).withColumn("_got", F.expr(f"cast(array() as array<{at}>)")).withColumn("_runs", F.expr(f"cast(array() as array<struct<from:{at},to:{at},most:double>>)"))
    fill = store(fill.withColumn("_gap", F.col("_gap").cast("double")).withColumn("_open", F.lit(True)), "mix-fill")
    nth = F.row_number().over(Window.partitionBy("source").orderBy(me))
    step = lambda acc, x: F.when(x["words"] <= acc["gap"], F.struct((acc["gap"] - x["words"]).alias("gap"), F.array_append(acc["got"], x["me"]).alias("got"))).otherwise(acc)
    while True:
        # The next ranks that fit what is missing, in order.
        rest = by_source(draws, fill.where("_open").select("_source", "_at", "_gap")).where((me > F.col("_at")) & (F.col("words") <= F.col("_gap")))
        queue = rest.withColumn("_nth", nth).where(F.col("_nth") <= FILL)
        queue = queue.groupBy(F.col("source").alias("_filled")).agg(F.array_sort(F.collect_list(F.struct(me.alias("me"), "words"))).alias("_queue"))
        fill = fill.join(queue, fill["_source"].eqNullSafe(queue["_filled"]) & fill["_open"], "left").drop("_filled")
        fill = fill.withColumn("_fold", F.aggregate("_queue", F.struct(F.col("_gap").alias("gap"), F.col("_got").alias("got")), step))
        fill = fill.withColumn("_gap", F.coalesce("_fold.gap", "_gap")).withColumn("_got", F.coalesce("_fold.got", "_got"))
        fill = fill.withColumn("_at", F.coalesce(F.element_at("_queue", -1)["me"], "_at")).withColumn("_open", F.coalesce(F.size("_queue") == FILL, F.lit(False)))
        fill = store(fill.drop("_queue", "_fold"), "mix-fill")
        more = fill.where("_open").select("_source", "_at", "_gap")
        if more.isEmpty():
            break
        # Then all that fit, up to the first that no longer does.
        rest = by_source(draws.drop("_left"), more).where((me > F.col("_at")) & (F.col("words") <= F.col("_gap"))).withColumn("_left", F.col("_gap")).drop("_at", "_gap")
        over = first_over(rest).select(F.col("_source").alias("_over"), F.col("_edge").alias("_to"), F.col("_gap").alias("_less"))
        sums = rest.groupBy(F.col("source").alias("_summed")).agg(F.sum("words").alias("_words"))
        fill = fill.join(over, fill["_source"].eqNullSafe(over["_over"]) & fill["_open"], "left").join(sums, fill["_source"].eqNullSafe(sums["_summed"]) & fill["_open"], "left")
        taken = F.struct(F.col("_at").alias("from"), F.col("_to").alias("to"), F.col("_gap").alias("most"))
        fill = fill.withColumn("_runs", F.when(F.col("_words").isNotNull(), F.array_append("_runs", taken)).otherwise(F.col("_runs")))
        fill = fill.withColumn("_gap", F.coalesce("_less", F.col("_gap") - F.col("_words"), "_gap").cast("double"))
        fill = fill.withColumn("_open", F.col("_to").isNotNull()).withColumn("_at", F.coalesce("_to", "_at"))
        fill = store(fill.drop("_over", "_to", "_less", "_summed", "_words"), "mix-fill")
    later = F.exists("_runs", lambda r: (me > r["from"]) & (r["to"].isNull() | (me < r["to"])) & (F.col("_words") <= r["most"]))
    got = F.coalesce(F.array_contains("_got", me) | later, F.lit(False))
    # The one document that comes nearest to the rest.
    off = F.struct(F.abs(F.col("_gap") - F.col("words")).alias("d"), me.alias("at"))
    closing = by_source(draws.withColumn("_words", F.col("words")), fill).where((me >= F.col("_edge")) & ~got).groupBy(F.col("source").alias("_closed")).agg(F.min(off).alias("_c"), F.max("_gap").alias("_g"))
    closing = closing.where(F.col("_c.d") < F.col("_g")).select("_closed", F.col("_c.at").alias("_close"))
    edges = store(fill.join(closing, fill["_source"].eqNullSafe(closing["_closed"]), "left").select("_source", "_edge", "_got", "_runs", "_close"), "mix-edges")

    rows = ranks(small if slim else docs.withColumn("_odds", _rounded(weight.cast("double"))))
    # The words of a draw, where rows repeat.
    alike = draws.where(F.col("words") > F.col("size")).select(F.col("source").alias("_s1"), F.col("doc_id").alias("_s2"), F.col("size").alias("_s3"), "words")
    alike = store(alike, "mix-alike")  # stored, so Spark knows that it is small where few rows repeat, and leaves texts where they are
    rows = rows.join(alike, rows["source"].eqNullSafe(F.col("_s1")) & rows["doc_id"].eqNullSafe(F.col("_s2")) & (rows["size"] == F.col("_s3")), "left")
    rows = rows.withColumn("_words", F.coalesce("words", "size")).drop("_s1", "_s2", "_s3", "words")
    out = by_source(rows, edges, "left")
    drawn = F.col("_key").isNotNull() & (F.col("size") > 0) & (F.col("_edge").isNull() | (me < F.col("_edge")) | got | (F.col("_close").isNotNull() & (me == F.col("_close"))))
    out = out.withColumn("copies", F.col("_whole") + F.when(drawn, 1).otherwise(0).cast("long"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[c for c in (["doc_id", "source"] if slim else docs.columns) if c != "size"], *own)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    names = docs.columns
    out = mix(docs, **options).where(F.col("copies") > 0)
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*names)
