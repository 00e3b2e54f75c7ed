"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words. Inside it a document's expected copies are in proportion to its
weight, by default one over the fourth root of its length, so that a source isn't spent on a few
long documents; none has more than `most`. Whole copies below that are certain. The rest, above 0 and
at most 1, is its inclusion probability, and documents are ranked by random odds over inclusion odds,
the Pareto order, of which a fixed number is taken.

So that a fixed number of documents is also a fixed number of words, samples are drawn by strata of
nearly equal length, longest first: each takes as many as bring the source's words closest to what
is expected so far, one more where shorter ones couldn't make up for it, and what it has too much or
too few is carried on to the shorter ones. What remains open in the end is the spread of lengths
within the strata.

How many to take comes from sums by source and stratum. Where the order is cut is found without
sorting a stratum: its ranks are counted in bins, then those of the one bin where the cut falls in
finer bins, then that bin in order. Bins grow with the root of the rows, so a stratum of any size
meets in no task, and no step depends on how many sources there are, but for one row of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.llm.columns import apart, restored
from logweave.llm.words import word_count
from logweave.operators.pinning import pin, pin_table

#: Weights are whole numbers of 2**-20, probabilities too, so that sums are exact in any order.
UNIT = 1 << 20
#: Strata of an octave of lengths, and rows that may lie in the last bin of a cut.
_STRATA_BITS, _LAST_BIN = 3, 256
_RANDOM_DIGITS = 13


def random_unit(seed: int, *columns: str) -> Column:
    """A uniform number in [0, 1) that hangs on the seed and the columns' values only."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))
    return F.conv(F.substring(digest, 1, _RANDOM_DIGITS), 16, 10).cast("double") / F.lit(float(16**_RANDOM_DIGITS))


def _key(source: Column) -> Column:
    """A source as a string that is never null: '' is the null one."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def stratum(size: Column) -> Column:
    """The octave of a length and the next bits below its highest, as one number; 0 for length 0."""
    octave = F.length(F.bin(size)) - 1
    low = F.greatest(octave - _STRATA_BITS, F.lit(0))
    return F.when(size > 0, octave * (1 << _STRATA_BITS) + F.call_function("shiftright", size, low.cast("int")) % (1 << _STRATA_BITS) + 1).otherwise(0).cast("int")


def _whole_weight(weight: Column) -> Column:
    """A weight in units of 2**-20, at least one, with its 8 highest bits only, so that few differ."""
    units = F.greatest(F.floor(weight * UNIT).cast("long"), F.lit(1).cast("long"))
    low = F.greatest(F.length(F.bin(units)) - 8, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", units, low), low)


def _before(order: W) -> W:
    return order.rowsBetween(W.unboundedPreceding, -1)


def source_targets(totals: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, weight, target) from one row (source, source_size) for each source.

    Sources in code point order, null last, take the weights in turn and share `share` of all sizes
    by weight. A target stops at `most` times its source's size; the excess goes to the others by
    weight until none is above: those with the least room for their weight are full first. Rows of
    sources, not of documents, meet in one task.
    """
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    table = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = W.partitionBy(F.lit(0))
    sums = table.withColumns({
        "nth": F.row_number().over(order), "full": F.coalesce(F.sum("cap").over(_before(order)), F.lit(0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(_before(order)), F.lit(0.0)), "words": F.sum("source_size").over(every),
    })
    level = (F.lit(float(share)) * F.col("words") - F.col("full")) / F.col("open")
    fits = F.when(F.col("weight") * level <= F.col("cap"), F.struct("nth", level.alias("level")))
    chosen = sums.withColumn("least", F.min(fits).over(every)["level"])
    target = F.least(F.col("weight") * F.coalesce("least", F.lit(float("inf"))), F.col("cap").cast("double"))
    return chosen.select("source", "source_size", "weight", target.alias("target"))


def _copies(weight: Column, per: Column, most: int) -> tuple[Column, Column]:
    """(certain copies, inclusion probability in units of 2**-20) of a document's weight, where one of weight 2**-20 is expected `per` times; null: the most."""
    expected = F.coalesce(F.least(F.lit(float(most)), per * weight), F.lit(float(most)))
    certain = F.greatest(F.ceil(expected) - 1, F.lit(0)).cast("long")
    chance = F.least(F.floor((expected - certain) * UNIT), F.lit(UNIT - 1)).cast("long")
    return certain, chance


def _per_weight(kinds: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(key, source_size, target, per): how many copies a weight of 2**-20 is expected to have; null where all have the most.

    `kinds`: key, w, words. Documents of the largest weights reach `most` first; the rest share by weight.
    """
    order, every = W.partitionBy("key").orderBy(F.desc("w")), W.partitionBy("key")
    weighed = F.col("w").cast("decimal(20,0)") * F.col("words").cast("decimal(17,0)")
    sums = kinds.where("words > 0").groupBy("key", "w").agg(F.sum("words").alias("words")).withColumns({
        "nth": F.row_number().over(order), "full": F.coalesce(F.sum("words").over(_before(order)), F.lit(0)),
        "rest": (F.sum(weighed).over(every) - F.coalesce(F.sum(weighed).over(_before(order)), F.lit(0))).cast("double"),
    })
    per = (F.col("target") - most * F.col("full")) / F.col("rest")
    fits = F.when(per * F.col("w") <= most, F.struct("nth", per.alias("per")))
    found = sums.join(targets.select("key", "target"), "key").groupBy("key").agg(F.min(fits).alias("least"))
    return targets.join(found, "key", "left").select("key", "source_size", "target", F.col("least.per").alias("per"))


def _takes(kinds: DataFrame, per: DataFrame, most: int) -> DataFrame:
    """(key, class, source_size, target, per, n_open, take): how many documents of a stratum get one copy more than is certain."""
    whole, chance = _copies(F.col("w"), F.col("per"), most)
    times = lambda a, b: F.sum(a.cast("decimal(20,0)") * b.cast("decimal(17,0)"))
    chance = F.when(F.col("words") > 0, chance).otherwise(0)
    rows = kinds.join(per, "key").withColumn("chance", chance).withColumn("spare", F.when(F.col("chance") > 0, UNIT - F.col("chance")).otherwise(0))
    strata = rows.groupBy("key", "class").agg(
        times(F.col("chance"), F.col("words")).cast("double").alias("words"), times(F.col("chance"), F.col("n")).cast("double").alias("expected"),
        times(F.col("spare"), F.col("words")).alias("spare"), F.sum(F.when(F.col("chance") > 0, F.col("n")).otherwise(0)).alias("n_open"),
    )
    # what shorter strata can take beyond what is expected of them
    later = F.coalesce(F.sum("spare").over(_before(W.partitionBy("key").orderBy("class"))), F.lit(0)).cast("double")
    lists = strata.withColumn("later", later).groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("class")).alias("order"), "words", "expected", "later", "n_open"))).alias("strata"))
    kind = "array<struct<class:int,n_open:bigint,take:bigint>>"

    def step(state: Column, s: Column) -> Column:
        due, mean = state["carry"] + s["words"] / UNIT, F.when(s["expected"] > 0, s["words"] / s["expected"]).otherwise(1.0)
        near = F.floor(due / mean + 0.5)
        near = F.when(due - near * mean > s["later"] / UNIT, near + 1).otherwise(near)
        take = F.greatest(F.lit(0).cast("long"), F.least(s["n_open"], near))
        return F.struct((due - take * mean).alias("carry"), F.concat(state["out"], F.array(F.struct((-s["order"]).alias("class"), s["n_open"].alias("n_open"), take.alias("take"))).cast(kind)).alias("out"))

    walked = F.aggregate("strata", F.struct(F.lit(0.0).alias("carry"), F.array().cast(kind).alias("out")), step, lambda state: state["out"])
    return lists.select("key", F.explode(walked).alias("s")).select("key", "s.*").join(per, "key")


def _rank(u: Column, chance: Column) -> Column:
    """The place in the Pareto order between 0 and 1: x / (1 + x) of the random odds over the inclusion odds; null where nothing is drawn."""
    odds = u / (1 - u) / F.when(chance > 0, chance / (UNIT - chance))
    return odds / (1 + odds)


def _cuts(units: DataFrame, takes: DataFrame) -> DataFrame:
    """(key, class, until): units (key, class, q, n) with q < until are the first `take` of their stratum, where not all are."""
    on = ["key", "class"]
    partial = takes.where("take > 0 and take < n_open").select(*on, F.col("take").alias("room"), F.ceil(F.sqrt("n_open") / F.lit(float(_LAST_BIN**0.5))).cast("long").alias("bins"))
    level, state = units.join(partial.select(*on, "bins"), on).withColumn("scale", F.col("bins")), partial.select(*on, "room")
    for _ in range(2):
        level = level.withColumn("bin", F.floor(F.col("q") * F.col("scale")).cast("long"))
        sums = level.groupBy(*on, "bin").agg(F.sum("n").alias("n"))
        run = sums.withColumn("upto", F.sum("n").over(W.partitionBy(*on).orderBy("bin"))).join(state, on)
        state = pin_table(run.where("upto > room").groupBy(*on).agg(F.min("bin").alias("cut_bin"), F.min_by(F.col("room") - (F.col("upto") - F.col("n")), "bin").alias("room")), "mix_bins")
        level = level.join(state.select(*on, "cut_bin"), on).where("bin = cut_bin").drop("bin", "cut_bin").withColumn("scale", F.col("bins") * F.col("bins"))
        state = state.drop("cut_bin")
    run = level.groupBy(*on, "q").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(W.partitionBy(*on).orderBy("q"))).join(state, on)
    return run.where("upto > room").groupBy(*on).agg(F.min("q").alias("until"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17, id_col: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (all, by default) of every row of `docs` with size, source_size, target, copies (0 to `most`) and taken = copies * size.

    Size is the number of words; a null or empty text has 0, adds nothing and is taken 0 times. Null is
    a source of its own. `weight` says how documents of a source share its target, by copies; null or
    less than 2**-20 counts as 2**-20. Randomness hangs on seed, id and text, so reruns agree, and rows that repeat
    with id and text share their fate. An empty table gives an empty result. Columns of `docs` that have the name of a
    result column are replaced. With `carry`, texts are read once, else twice.
    """
    kept = carry if carry is not None else [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    size = word_count(text)
    of_text = docs.select(_key(F.col(source)).alias("__key"), F.col(source).cast("string").alias("__source"), size.alias("__size"), (F.lit(0.0) if weight is None else weight.cast("double")).alias("__own"), random_unit(seed, id_col, text).alias("__u"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(kept)])
    of_text = of_text.withColumn("__class", stratum(F.col("__size"))).withColumn("__w", _whole_weight(F.coalesce("__own", F.lit(0.0)) if weight is not None else 1 / F.sqrt(F.sqrt(F.greatest("__size", F.lit(1)).cast("double"))))).drop("__own")
    narrow = ["__key", "__source", "__size", "__u", "__class", "__w"]
    rows = pin(of_text if carry is not None else of_text.select(*narrow))
    kinds = pin_table(rows.groupBy(F.col("__key").alias("key"), F.col("__source").alias("source"), F.col("__class").alias("class"), F.col("__w").alias("w")).agg(F.count("*").alias("n"), F.sum("__size").alias("words")), "mix_kinds")
    targets = source_targets(kinds.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most).withColumn("key", _key(F.col("source")))
    takes = pin_table(_takes(kinds, _per_weight(kinds, targets, most), most), "mix_takes")
    chance = _copies(F.col("__w"), F.col("per"), most)[1]
    units = rows.where("__size > 0").join(takes.withColumnsRenamed({"key": "__key", "class": "__class"}), ["__key", "__class"]).select(F.col("__key").alias("key"), F.col("__class").alias("class"), _rank(F.col("__u"), chance).alias("q"))
    units = units.where("q is not null").groupBy("key", "class", "q").agg(F.count("*").alias("n"))
    cut = F.when(F.col("take") >= F.col("n_open"), F.lit(2.0)).when(F.col("take") == 0, F.lit(-1.0)).otherwise(F.coalesce("until", F.lit(2.0)))
    plan = pin_table(takes.join(_cuts(units, takes), ["key", "class"], "left").select(F.col("key").alias("__key"), F.col("class").alias("__class"), "source_size", "target", F.col("per").alias("__per"), cut.alias("__until")), "mix_plan")
    whole, chance = _copies(F.col("__w"), F.col("__per"), most)
    both = (rows if carry is not None else of_text).join(plan, ["__key", "__class"], "left")
    more = F.coalesce(_rank(F.col("__u"), chance) < F.col("__until"), F.lit(False)).cast("long")
    copies = F.when(F.col("__size") > 0, whole + more).otherwise(F.lit(0)).cast("long")
    return both.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)], F.col("__size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("__size")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix with the columns of `docs`: each as often as it is taken."""
    mixed = mix_sources(apart(docs), **how)
    return restored(mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))), docs.columns)
