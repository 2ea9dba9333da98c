"""Mixing sources to target weights by Pareto order sampling (operator 9).

A source's target is its weight's share of all words, held to `most` times what
the source has, the excess going to the others by weight. Each of its documents
gets floor(target / size of source) certain copies. Further copies go to a Pareto
sample of unequal chances: a document of n words has the chance min(1, c * n ** LEAN),
c such that the expected words are what is left to the target, so longer documents
are likelier and the longest may be certain. Documents are ranked by u / (1 - u) over
p / (1 - p), u random by document and p its chance, and taken in this order while
they fit into what is left; one that does not fit is passed over, and those behind it
go on, round by round, until nothing left fits: the size of the sample is fixed in
words. Then the document that comes closest to the gap that remains is taken too, if
that brings the source nearer to its target. DataFrame expressions only.

Ranks are never sorted within a source: words are summed over `BINS` intervals
of the rank, and only the interval in which the target falls is put in order. A round
leaves a gap below the document that stopped it, about half of it on average, so there
are about as many rounds as the longest document's size has bits.
What a row gets depends on its rank and on a few figures of its source, so the
texts are not shuffled, rows that agree in id and size are treated alike (they go in
together or not at all), and reruns agree. Null texts have size 0, the null source comes
last, documents with a null id share a rank by size; empty tables give empty results;
texts of any length are counted whole. Sources are put in order in one task (a row each),
and so are the different sizes of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small

BINS = 4096
MOST_ROUNDS = 1000
#: The power of its size to which a document's chance of a further copy is proportional.
LEAN = 0.5
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rank_of(doc_id: Column, size: Column, chance: Column, seed: int) -> Column:
    """The Pareto rank q mapped to q / (1 + q), in (0, 1); chance is within (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, size, F.lit(seed)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    q = F.try_divide(u / (1 - u) * (1 - chance), chance)
    return q / (1 + q)


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """source, source_size, target: shares of all words by weight, at most `most` times the source.

    Sources fill up in the order of their limit over their weight, so running
    sums over the sorted sources give the level at which the rest is even.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    t = sources.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    t = t.withColumn("level", level).withColumn("full", F.col("cap") < F.col("level") * F.col("w"))
    even = F.max(F.when(~F.col("full"), F.struct(-F.col("cap") / F.col("w"), F.col("level")))).over(every)
    return t.withColumn("even", even["level"]).select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("even") * F.col("w"))).alias("target"))


def chance_of(pace: Column, size: Column) -> Column:
    """A document's chance of a further copy; a certain one stays just below 1, so that it has a rank."""
    return F.least(pace * F.pow(size, F.lit(LEAN)), F.lit(1 - 1e-9))


def with_pace(by_source: DataFrame, units: DataFrame) -> DataFrame:
    """Adds `pace`, the c of the chances: the expected words of the further copies are `left`.

    Sizes whose chance would pass 1 are certain, the largest first; what they leave
    is shared by the smaller ones.
    """
    sizes = units.filter("size > 0").groupBy("source", "size").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("words"))
    left = by_source.select("source", "left")
    lean = F.pow("size", F.lit(LEAN))
    order = Window.partitionBy("z.source").orderBy(F.desc("size"))
    larger = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    here = F.sum(F.col("words") * lean).over(order.rowsBetween(0, Window.unboundedFollowing))
    each = sizes.alias("z").join(left.alias("l"), F.col("z.source").eqNullSafe(F.col("l.source"))).select("z.source", "size", lean.alias("lean"), ((F.col("left") - larger) / here).alias("c"))
    # The first size that is not certain sets the pace; where all are, any pace at which they are will do.
    pace = each.groupBy("source").agg(F.coalesce(F.max_by("c", F.when(F.col("c") * F.col("lean") < 1, F.col("size"))), F.max(1 / F.col("lean"))).alias("pace"))
    return by_source.alias("s").join(pace.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")), "left").select("s.*", F.when(F.col("left") > 0, F.greatest("pace", F.lit(0.0))).otherwise(0.0).alias("pace"))


def _fits(rounds: Column, rank: Column, words: Column) -> Column:
    """Whether some round took a document of this rank and size."""
    return F.exists(rounds, lambda r: (rank > r["above"]) & (rank <= r["upto"]) & (words <= r["most"]))


def _round(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """state (source, gap, above, rounds, going) after one more stretch of ranks has been taken.

    Of the documents behind `above` that fit into the gap one by one, those go in that fit
    together, up to the first that no longer does. Words are summed by interval of the
    rank, and only the interval in which the gap is filled is put in order.
    """
    open_ = ranked.alias("r").join(state.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).filter("s.going and r.rank > s.above and r.words <= s.gap").select("r.*", "gap")
    bins = open_.groupBy("source", "bin", "gap").agg(F.sum("words").alias("words")).withColumn("sum", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
    full = F.min(F.when(F.col("sum") > F.col("gap"), F.struct("bin", (F.col("sum") - F.col("words")).alias("before"))))
    edge = bins.groupBy("source").agg(full.alias("e"), F.max("sum").alias("all")).select("source", "e.bin", "e.before", "all")
    within = Window.partitionBy("source").orderBy("rank")  # rows of one rank count together
    at_edge = open_.alias("r").join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.bin") == F.col("e.bin"))).select("r.*", "before").withColumn("sum", F.sum("words").over(within) + F.col("before"))
    last = at_edge.filter("sum <= gap").groupBy("source").agg(F.max(F.struct("rank", "sum")).alias("m"))
    e, m = F.col("e.bin"), F.col("l.m")
    upto = F.when(e.isNull(), 2.0).otherwise(F.coalesce(m["rank"], e / BINS - 1e-15))
    got = F.when(e.isNull(), F.col("e.all")).otherwise(F.coalesce(m["sum"], F.col("e.before")))
    met = state.alias("s").join(edge.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left").join(last.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left")
    moved = F.col("e.all").isNotNull()
    taken = F.struct(F.col("s.above").alias("above"), upto.alias("upto"), F.col("s.gap").alias("most"))
    made = met.select(
        "s.source", F.when(moved, F.col("s.gap") - got).otherwise(F.col("s.gap")).alias("gap"), F.when(moved, upto).otherwise(F.col("s.above")).alias("above"),
        F.when(moved, F.concat("s.rounds", F.array(taken))).otherwise(F.col("s.rounds")).alias("rounds"), (moved & e.isNotNull()).alias("going"),
    )
    return cut(made, state)


def plan(units: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """A row for each source (target, certain copies, and which ranks get one copy more), and the ranks that go out again.

    units: source, doc_id, size, n (rows that agree in these). The second table,
    (source, rank), has units of several rows that do not fit together where one would.
    """
    by_source = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(ratio + 1e-12), F.lit(int(most))).cast("long")
    by_source = by_source.withColumn("copies", whole).withColumn("left", F.when(ratio - whole > 0, F.col("target") - whole * F.col("source_size")).otherwise(0.0))
    by_source = small(cut(with_pace(by_source, units)))
    same = F.col("u.source").eqNullSafe(F.col("s.source"))
    ranked = (
        units.filter("size > 0").alias("u").join(by_source.alias("s"), same).filter("s.pace > 0")
        .select("u.source", "u.size", (F.col("u.size") * F.col("u.n")).alias("words"), rank_of(F.col("u.doc_id"), F.col("u.size"), chance_of(F.col("s.pace"), F.col("u.size")), seed).alias("rank"))
        .groupBy("source", "rank").agg(F.sum("words").alias("words"), F.min("size").alias("size")).withColumn("bin", F.floor(F.col("rank") * BINS))
    )
    ranked = cut(ranked)
    no_rounds = F.array().cast("array<struct<above:double,upto:double,most:double>>")
    state = cut(by_source.select("source", F.col("left").alias("gap"), F.lit(-1.0).alias("above"), no_rounds.alias("rounds"), (F.col("pace") > 0).alias("going")))
    for _ in range(MOST_ROUNDS):
        if state.filter("going").isEmpty():
            break
        state = _round(ranked, state)
    else:
        raise RuntimeError("the mix did not settle")
    state = small(state)
    told = ranked.alias("r").join(state.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.gap", "s.rounds")
    taken = _fits(F.col("rounds"), F.col("rank"), F.col("words"))
    filler = told.filter(~taken & (F.col("words") < 2 * F.col("gap"))).groupBy("source").agg(F.min(F.struct(F.abs(F.col("words") - F.col("gap")).alias("off"), "rank")).alias("f")).select("source", F.col("f.rank").alias("filler"))
    out = told.filter("size < words").filter(_fits(F.col("rounds"), F.col("rank"), F.col("size")) & ~taken).select("source", "rank")
    chosen = (
        by_source.alias("s").join(state.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source"))).join(filler.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left")
        .select("s.source", "s.source_size", "s.target", "s.copies", "s.pace", "c.rounds", F.coalesce("f.filler", F.lit(-1.0)).alias("filler"))
    )
    return cut(chosen), cut(out)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 9) -> DataFrame:
    """docs with size, source_size, target, copies and taken = copies * size; rows with no copies stay, with 0.

    Input columns of these names give way to the results.
    """
    sized = docs.withColumn("__ns_size", size_of(F.col("text")))
    units = cut(sized.groupBy("source", "doc_id", F.col("__ns_size").alias("size")).agg(F.count("*").alias("n")))
    chosen, out = plan(units, weights, most, seed)
    chosen = small(chosen).select(*[F.col(c).alias(f"__ns_{c}") for c in ("source", "source_size", "target", "copies", "pace", "rounds", "filler")])
    mixed = sized.join(chosen, F.col("source").eqNullSafe(F.col("__ns_source")))
    mixed = mixed.withColumn("__ns_rank", rank_of(F.col("doc_id"), F.col("__ns_size"), chance_of(F.col("__ns_pace"), F.col("__ns_size")), seed))
    rank, size = F.col("__ns_rank"), F.col("__ns_size")
    extra = (size > 0) & (F.col("__ns_pace") > 0) & (_fits(F.col("__ns_rounds"), rank, size) | (rank == F.col("__ns_filler")))
    if not out.isEmpty():
        gone = small(out).select(F.col("source").alias("__ns_out"), F.col("rank").alias("__ns_out_rank"), F.lit(True).alias("__ns_gone"))
        mixed = mixed.join(gone, F.col("source").eqNullSafe(F.col("__ns_out")) & (rank == F.col("__ns_out_rank")), "left")
        extra = extra & (F.col("__ns_gone").isNull() | (rank == F.col("__ns_filler")))
    copies = F.col("__ns_copies") + F.coalesce(extra.cast("long"), F.lit(0))
    own = ("size", "source_size", "target", "copies", "taken")
    return mixed.select(*[F.col(c) for c in docs.columns if c not in own], size.alias("size"), F.col("__ns_source_size").alias("source_size"), F.col("__ns_target").alias("target"), copies.alias("copies"), (copies * size).alias("taken"))
