"""Mixing sources to target weights by entropy balancing.

Every document gets a rate ``min(cap, exp(lambda_source * size / mean_size))``.
The multipliers solve the convex dual of the maximum-entropy problem "words
taken from a source equal its target"; each Newton step is one distributed
aggregation for all sources at once, kept inside a bracket so that it always
converges. Rates become copies by sequential Poisson rounding: documents are
ordered by ``hash / fraction`` and taken up to the remaining words, from the
longest size class down to the shortest so that the last corrections are small.

All sums are of integers, so that reruns and other partitionings agree. Sources
are rows of a table throughout; while that table is tiny its rows are literals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._base import GAP, keep, settled

WEIGHTS = (5, 2, 1)
CAP = 3
#: Fixed-point scale of the distributed sums.
SCALE = 1024
#: Lower bounds of the size classes that are rounded in turn, longest first.
CLASSES = (1024, 64, 0)
#: Most sources whose table is broadcast; above it the joins are shuffled.
BROADCAST_SOURCES = 100_000


def numbered(sources: DataFrame) -> DataFrame:
    """Sources in order of their code points, null last, with a number ``sid`` from 0."""
    order = F.col("source").asc_nulls_last()
    placed = settled(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, offset = 0, []
    for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():  # one row for each partition
        offset += [F.lit(r["p"]), F.lit(before)]
        before += r["n"]
    shift = F.create_map(*offset)[part] if offset else F.lit(0)
    return placed.withColumn("sid", (shift + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_at")


def water_fill(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds ``target``: the sum of ``size`` shared by ``weight``, nobody getting more than ``cap`` times its size.

    What is above a cap is shared again by weight among the others until none
    is above. The level only rises, so that each round needs the sums on both
    sides of it and nothing else.
    """
    limit = F.lit(float(cap)) * F.col("size")
    sums = sources.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    total, left, weight = float(sums["size"] or 0), float(sums["size"] or 0), float(sums["weight"] or 1)
    while True:
        above = F.lit(left) * F.col("weight") / F.lit(weight) > limit
        now = sources.agg(F.sum(F.when(above, limit)).alias("fixed"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        rest = total - (now["fixed"] or 0.0)
        if not now["free"] or (rest, now["free"]) == (left, weight):
            return sources.withColumn("target", F.when(above, limit).otherwise(F.lit(left) * F.col("weight") / F.lit(weight)))
        left, weight = rest, float(now["free"])


def _solve(hist: DataFrame, sources: DataFrame, cap: float, steps: int, near: Callable) -> DataFrame:
    """Newton iterations on the dual, for all sources at once; adds ``lam``.

    ``hist`` has sid, size, n. A step that leaves the bracket is replaced by
    bisection, or by doubling while one side is still open.
    """
    size, target, lam = F.col("size"), F.col("target"), F.col("lam")
    full, none = (size > 0) & (target >= cap * size), (size > 0) & (target <= 0)
    state = sources.select(
        "sid", "size", "mean", "target",
        F.when(full, float("inf")).when(none, float("-inf")).otherwise(0.0).alias("lam"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), ((size == 0) | full | none).alias("done"),
    )
    state = settled(state)
    for _ in range(steps):
        if not state.where("NOT done").limit(1).count():
            break
        todo = state.where("NOT done").select("sid", "lam", "mean")
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(lam * x, F.lit(60.0)))
        rate = F.least(F.lit(float(cap)), tilt)
        value = (F.col("size") * rate * SCALE).cast("long") * F.col("n")
        slope = F.when(tilt < cap, (F.col("size") * rate * x * SCALE).cast("long") * F.col("n")).otherwise(0)
        got = hist.join(near(todo), "sid").groupBy("sid").agg((F.sum(value) / SCALE).alias("value"), (F.sum(slope) / SCALE).alias("slope"))
        gap = target - F.col("value")
        moved = state.where("NOT done").join(near(got), "sid").select(
            "sid", "size", "mean", "target", "lam", gap.alias("gap"), F.when(gap > 0, lam).otherwise(F.col("lo")).alias("lo"), F.when(gap > 0, F.col("hi")).otherwise(lam).alias("hi"),
            F.when(F.col("slope") > 0, lam + gap / F.col("slope")).alias("step"), (2 * lam + F.when(gap > 0, 1).otherwise(-1)).alias("far"),
        )
        met = F.abs("gap") <= F.greatest(F.lit(0.5), 1e-6 * target)
        closed = F.col("lo").isNotNull() & F.col("hi").isNotNull()
        wide = F.when(F.abs(F.col("step") - lam) <= F.abs(F.col("far") - lam), F.col("step")).otherwise(F.col("far"))
        inner = F.when((F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)
        tight = closed & (F.col("hi") - F.col("lo") < 1e-12 * F.greatest(F.lit(1.0), F.abs("lo")))
        moved = moved.select(
            "sid", "size", "mean", "target", F.when(met, lam).when(closed, inner).otherwise(wide).alias("lam"), "lo", "hi", F.coalesce(met | tight, F.lit(False)).alias("done")
        )
        state = settled(state.where("done").unionByName(moved))
    return sources.join(state.select("sid", "lam"), "sid")


def _rate(cap: float) -> Column:
    lam, size = F.col("lam"), F.col("size")
    grown = F.exp(F.least(lam * size / F.col("mean"), F.lit(60.0)))
    return F.when(size == 0, 0.0).when(lam == float("inf"), float(cap)).otherwise(F.least(F.lit(float(cap)), grown))


def _straddle(rows: DataFrame, need: DataFrame, bin_: Column, near: Callable) -> DataFrame:
    """(sid, bin, below, need): for each source the bin in which the running size reaches ``need``, and the size below it.

    The windows run over at most a fixed number of bins for each source.
    """
    per_bin = rows.groupBy("sid", bin_.alias("bin")).agg(F.sum("size").alias("s"))
    below = F.sum("s").over(Window.partitionBy("sid").orderBy("bin")) - F.col("s")
    reached = (F.col("below") < F.col("need")) & (F.col("below") + F.col("s") >= F.col("need"))
    return per_bin.withColumn("below", below).join(near(need), "sid").where(reached).select("sid", "bin", "below", "need")


def _round(rows: DataFrame, near: Callable) -> DataFrame:
    """(sid, cls, mkey, mid): the last document taken of each source and size class."""
    sums = rows.where("part > 0").groupBy("cls", "sid").agg((F.sum((F.col("size") * F.col("part") * SCALE).cast("long")) / SCALE).alias("want"), F.sum("size").alias("s"))
    sums = settled(sums)
    carry, marks = None, None
    for c in range(len(CLASSES)):
        part = rows.where((F.col("cls") == c) & (F.col("part") > 0))
        own = sums.where(F.col("cls") == c).select("sid", "want", "s")
        own = own.withColumn("goal", F.col("want")) if carry is None else own.join(near(carry), "sid", "left").withColumn("goal", F.col("want") + F.coalesce("carry", F.lit(0.0)))
        own = settled(own.select("sid", "s", "goal"))
        first = settled(_straddle(part, own.select("sid", F.col("goal").alias("need")), F.shiftright("key", 24), near))
        at = first.select("sid", F.col("bin").alias("b1"), (F.col("need") - F.col("below")).alias("need"))
        inner = part.join(near(at.select("sid", "b1")), "sid").where(F.shiftright("key", 24) == F.col("b1"))
        second = settled(_straddle(inner, at.select("sid", "need"), F.shiftright("key", 12), near))
        at = second.select("sid", F.col("bin").alias("b2"), (F.col("need") - F.col("below")).alias("left"))
        # Rows that repeat an id and a size are one entry of the order.
        tail = part.join(near(at), "sid").where(F.shiftright("key", 12) == F.col("b2")).groupBy("sid", "key", "id", "left").agg(F.sum("size").alias("same"))
        upto = F.sum("same").over(Window.partitionBy("sid").orderBy("key", "id"))
        last = tail.withColumn("upto", upto).where(F.col("upto") - F.col("same") / 2 <= F.col("left")).groupBy("sid").agg(F.max(F.struct("key", "id")).alias("m"), F.max("upto").alias("upto"))
        found = (
            own.join(near(first.select("sid", F.col("below").alias("below1"))), "sid", "left")
            .join(near(second.select("sid", F.col("bin").alias("b2"), F.col("below").alias("below2"))), "sid", "left").join(near(last), "sid", "left")
        )
        below = F.col("below1") + F.col("below2")
        case = lambda no, whole, exact, under: F.when(F.col("goal") <= 0, no).when(F.col("below1").isNull(), whole).when(F.col("m").isNotNull(), exact).otherwise(under)
        found = settled(found.select(
            "sid", F.lit(c).alias("cls"), (F.col("goal") - case(F.lit(0), F.col("s"), below + F.col("upto"), below)).alias("carry"),
            case(F.lit(-1), F.lit(1 << 62), F.col("m.key"), F.shiftleft("b2", 12) - 1).cast("long").alias("mkey"), case(F.lit(0), F.lit(0), F.col("m.id"), F.lit((1 << 63) - 1)).cast("long").alias("mid"),
        ))
        # Sources without documents of this class keep what they carry.
        now = found.select("sid", "carry")
        carry = now if carry is None else now.unionByName(carry.join(near(now.select("sid")), "sid", "left_anti"))
        marks = found.drop("carry") if marks is None else marks.unionByName(found.drop("carry"))
    return settled(marks)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    cap: int = CAP,
    steps: int = 80,
    seed: int = 7,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Copies of each document so that the words of each source reach its target.

    Returns one row per input row: doc_id, source, size, source_size, target,
    rate, copies, taken. ``size`` counts words; a null text has none and is
    never taken. Null sources form one source, sorted last. Sources without
    words get target 0. Rows that repeat a doc_id are kept apart and get the
    same copies; a null doc_id counts as the smallest. An empty table gives an
    empty result. Only the three named columns are read, so that others may
    have any name.
    """
    # Words are what lies between white space; the text may begin or end with it.
    flat = F.coalesce(F.col(text), F.lit(""))
    size = F.size(F.array_remove(F.split(flat, GAP), "")).cast("long")
    sized = keep(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size")))
    hist = keep(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("docs"))
    sources = numbered(totals)
    given = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("weight", F.get(given, (F.col("sid") % len(weights)).cast("int"))).withColumn("mean", F.when(F.col("size") > 0, F.col("size") / F.col("docs")).otherwise(1.0))
    few = sources.count() <= BROADCAST_SOURCES
    near = F.broadcast if few else (lambda df: df)
    sources = settled(water_fill(sources, cap))
    ids = sources.select("sid", F.col("source").alias("k"))
    own = hist.join(near(ids), hist.source.eqNullSafe(ids.k)).select("sid", "size", "n")
    solved = settled(_solve(own, sources, cap, steps, near)).select("sid", F.col("source").alias("k"), F.col("size").alias("source_size"), "target", "lam", "mean")
    unit = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 62))), F.lit(seed)), 12) + 1) / float(1 << 52)
    cls = F.lit(len(CLASSES) - 1)
    for c in reversed(range(len(CLASSES) - 1)):
        cls = F.when(F.col("size") >= CLASSES[c], c).otherwise(cls)
    rows = (
        sized.join(near(solved), sized.source.eqNullSafe(solved.k))
        .drop("k")
        .withColumn("rate", _rate(cap))
        .withColumn("part", F.col("rate") - F.floor("rate"))
        .withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
        .withColumn("key", F.when(F.col("part") > 0, (F.least(unit / F.col("part"), F.lit(15.0)) * (1 << 32)).cast("long")))
        .withColumn("cls", cls)
    )
    marks = _round(rows, near)
    more = (F.col("part") > 0) & ((F.col("key") < F.col("mkey")) | ((F.col("key") == F.col("mkey")) & (F.col("id") <= F.col("mid"))))
    copies = (F.floor("rate") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)).cast("long")
    return (
        rows.join(near(marks), ["sid", "cls"], "left")
        .withColumn("copies", copies)
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
