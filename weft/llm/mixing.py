"""Operator 2, mixing sources to target weights by entropy balancing.

Every source has a token target. Among all document rates r the one that minimises

    sum_i  c_i (r_i log r_i - r_i)      subject to  sum_i size_i r_i = target,  r_i <= MAX_COPIES

is exponentially tilted: r_i = min(MAX_COPIES, exp(lambda * x_i)) with x_i = (size_i / c_i) / scale, where the document's
cost is c_i = size_i ** COST_POWER (0 weighs documents alike, 1 weighs words alike and makes rates uniform), and the
scale is the word-weighted mean of size_i / c_i. The multiplier of each source is the root of the convex dual's
gradient; safeguarded Newton steps on its logarithm find it. The steps are aggregations over (source, size) counts,
one row for each distinct size, whose number does not grow with the documents; the multipliers stay in a table. If they
do not reach TOLERANCE, the query fails rather than go on with wrong rates.

Rates become copies by systematic rounding of their running total in order of size (a total over the counts, not over
documents), and the words that the whole copies leave over or lack are then settled with the shortest documents that
can take or give copies. A document's copies follow from its rank among those of its source and size; a group of more
than SALT_ROWS documents is dealt into salts, which share its copies by their running numbers, so that no task ranks a
hot group alone. All sums that decide are integers, so that reruns agree.

Null and empty texts have size 0 and take nothing. A null source is a source of its own, the last. Repeated rows are
documents of their own. Empty tables give empty results. Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import discard, materialize

WEIGHTS, MAX_COPIES, COST_POWER = (1, 2, 3), 3, 0.5
#: Newton stops at this relative error of each source's words; steps between two looks at it; most looks.
TOLERANCE, STEPS, LOOKS = 2e-5, 5, 20
#: Documents for one salt.
SALT_ROWS = 100_000
_UNIT = 1_000_000


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, a key that is never null, and the number of words."""
    size = F.expr(r"cast(regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as long)")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("source_key"), size.alias("size"))


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """Targets of sources (source_key, source, source_size): weights repeat by code point, nulls last; capped, the excess reshared."""
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    filling = Window.orderBy("fill", "source_key")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    out = out.withColumn("share", F.col("weight") / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("capped", F.col("cap") <= F.col("left") * F.col("share"))
    first = F.min(F.when(~F.col("capped"), F.col("fill"))).over(everything)
    # the level is that of the first source below its cap
    out = out.withColumn("level", F.max(F.when(~F.col("capped") & (F.col("fill") == first), F.col("left") * F.col("share") / F.col("weight"))).over(everything))
    return out.select("source_key", "source", "source_size", F.when(F.col("capped") | F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def _rate(multiplier, tilt, most: int):
    """The rate in millionths."""
    return F.when(multiplier.isNull(), F.lit(0)).otherwise(F.round(F.least(F.lit(float(most)), F.exp(F.least(multiplier * tilt, F.lit(5.0)))) * _UNIT)).cast("long")


def _newton(counts: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """One safeguarded Newton step of every source's multiplier."""
    joined = counts.select("source_key", "size", "n", "root").join(state, "source_key").withColumn("tilt", F.col("root") / F.col("scale"))
    rate = _rate(F.col("multiplier"), F.col("tilt"), most)
    free = rate < most * _UNIT
    words = (F.col("n") * F.col("size")).cast("decimal(24,0)")
    summed = joined.withColumn("rate", rate).groupBy("source_key").agg(
        *[F.first(c).alias(c) for c in ("target", "source_size", "scale", "multiplier", "low", "high")],
        (F.sum(words * F.col("rate")).cast("double") / _UNIT).alias("value"),
        (F.sum(F.when(free, words * F.round(F.col("rate") * F.col("tilt")).cast("decimal(13,0)"))).cast("double") / _UNIT).alias("slope"),
    )
    low = F.when(F.col("value") < F.col("target"), F.greatest("low", "multiplier")).otherwise(F.col("low"))
    high = F.when(F.col("value") > F.col("target"), F.least("high", "multiplier")).otherwise(F.col("high"))
    step = F.col("multiplier") - (F.log("value") - F.log("target")) * F.col("value") / F.col("slope")
    bounded = F.when((F.col("slope") > 0) & (F.col("value") > 0) & (step > low) & (step < high), step).otherwise((low + high) / 2)
    # rates are whole millionths, which a source's words cannot undercut
    error = F.greatest(F.abs(F.col("value") - F.col("target")) - F.col("source_size") / _UNIT, F.lit(0.0)) / F.col("target")
    return summed.select("source_key", "target", "source_size", "scale", F.when(error <= TOLERANCE / 10, F.col("multiplier")).otherwise(bounded).alias("multiplier"), low.alias("low"), high.alias("high"), error.alias("error"))


def solve(counts: DataFrame, targets: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """Multiplier and scale of every source, by distributed Newton iterations; null where a source takes nothing."""
    moments = counts.where("size > 0").groupBy("source_key").agg((F.sum(F.col("n") * F.col("size") * F.round(F.col("root") * 1000).cast("decimal(24,0)")).cast("double") / 1000 / F.sum(F.col("n") * F.col("size"))).alias("scale"), F.min("root").alias("least"))
    start = targets.where("target > 0").join(moments, "source_key")
    ratio = F.log(F.col("target") / F.col("source_size"))
    # every rate reaches its cap at the upper bound; Jensen's inequality gives the others
    top = (F.log(F.lit(float(most))) + 1e-6) * F.col("scale") / F.col("least")
    state = start.select("source_key", "target", "source_size", "scale", F.when(F.col("target") >= most * F.col("source_size") * (1 - 1e-12), top).otherwise(ratio).alias("multiplier"), F.least(ratio * F.col("scale") / F.col("least"), F.lit(-1e-9)).alias("low"), F.greatest(top, ratio).alias("high"), F.lit(1.0).alias("error"))
    written = None
    for _ in range(LOOKS):
        for _ in range(STEPS):
            state = _newton(counts, state, most)
        state = materialize(state)
        if written is not None:
            discard(written)
        written = state
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst <= TOLERANCE:
            return state.select("source_key", "multiplier", "scale")
    raise ArithmeticError(f"Newton steps leave a relative error of {worst} after {LOOKS * STEPS} steps")


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_COPIES, cost_power: float = COST_POWER, salt_rows: int = SALT_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate and source for each row of ``docs`` (doc_id, text, source)."""
    sizes = materialize(word_sizes(docs))
    root = F.round(F.pow(F.col("size").cast("double"), F.lit(1 - cost_power)), 6)
    counts = materialize(sizes.groupBy("source_key", "source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("root", root))
    sources = counts.groupBy("source_key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = materialize(source_targets(sources, weights, most))
    solved = solve(counts, targets, most)

    by_size = Window.partitionBy("source_key").orderBy("size")
    upto = by_size.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source_key")
    plan = counts.drop("source").join(targets, "source_key").join(solved, "source_key", "left")
    plan = plan.withColumn("rate", _rate(F.col("multiplier"), F.col("root") / F.col("scale"), most))
    total = F.sum(F.col("n") * F.col("rate")).over(upto)
    plan = plan.withColumn("total", total).withColumn("copies", (F.expr(f"(total + {_UNIT // 2}) div {_UNIT}") - F.expr(f"(total - n * rate + {_UNIT // 2}) div {_UNIT}")).cast("long"))
    plan = plan.withColumn("lacking", F.round("target").cast("long") - F.sum(F.col("copies") * F.col("size")).over(whole))
    room = F.when(F.col("lacking") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies")) * F.col("size")
    plan = plan.withColumn("room", room).withColumn("before", F.sum("room").over(upto) - F.col("room"))
    settled = F.expr("case when size > 0 then least(greatest(0, abs(lacking) - before) + size div 2, room) div size else 0 end")
    plan = plan.withColumn("copies", F.col("copies") + F.signum("lacking").cast("long") * settled)
    salts = F.ceil(F.col("n") / salt_rows).cast("long")
    plan = materialize(plan.select("source_key", "size", "n", "copies", "rate", "source_size", "target", salts.alias("salts")))

    joined = sizes.join(plan, ["source_key", "size"]).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    # the share of each salt of a large group in what its copies are more than a multiple of its documents
    large = plan.where("salts > 1").select("source_key", "size", "salts")
    running = Window.partitionBy("source_key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    held = sizes.join(large, ["source_key", "size"]).groupBy("source_key", "size", F.pmod(F.xxhash64("doc_id"), F.col("salts")).alias("salt")).agg(F.count(F.lit(1)).alias("held"))
    upper = held.withColumn("upto", F.sum("held").over(running))
    joined = joined.join(upper, ["source_key", "size", "salt"], "left")
    rest = "cast(copies % n as decimal(38, 0))"
    extra = F.expr(f"case when upto is null then copies % n else cast({rest} * upto div n - {rest} * (upto - held) div n as long) end")
    member = Window.partitionBy("source_key", "size", "salt").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
    copies = F.expr("copies div n") + (F.row_number().over(member) <= extra).cast("long")
    joined = joined.withColumn("taken_copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long"))
    return joined.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("taken_copies") * F.col("size")).alias("taken"), F.col("taken_copies").alias("copies"), (F.col("rate") / _UNIT).alias("rate"), "source")
