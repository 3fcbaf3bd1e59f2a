"""Mix sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / source size`` times. The whole part is taken; the
fractions are rounded in dependence: two documents exchange words, in a random direction whose expectation
is zero, until one of them is taken or left, and the other carries the rest on. The words of a source
stay the same at every exchange, so only the last document of a source moves its sum. Exchanges run inside
chunks of about ``CHUNK`` documents, and what is left of ``CHUNK`` chunks meets in the next level of the
tree, so that a source of any size is spread over as many tasks as it has chunks.

Only DataFrame functions are used, and no randomness but hashes of the rows: reruns agree.

Defined cases: a null text has size 0 and is taken as often as the whole part says (0 words); a null source
is a source of its own, the last; repeated rows are rounded each on their own; an empty table gives an empty
one; other columns, whatever their names, are ignored by ``mix`` and kept by ``taken_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, spare, stage, text_or_empty

CHUNK = 128
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)


def words(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target``: shares by weight, none above ``most`` times its source.

    The sources that stop at their limit are those with the least room for their weight, so one pass
    over the sources in that order finds the level of the rest. There is a row for each source here.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    limited = sources.withColumn("weight", weight.cast("double")).withColumn(
        "limit", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum(F.col("source_size").cast("double")).over(every) - F.sum("limit").over(here)
             + F.col("limit")) / F.sum("weight").over(rest)
    levelled = limited.withColumn("level", level).withColumn(
        "free", F.col("limit") > F.col("level") * F.col("weight"))
    # the first free source has the level of all free ones; it is the highest of theirs
    shared = F.max(F.when(F.col("free"), F.col("level"))).over(every)
    return levelled.withColumn("target", F.when(F.col("free"), shared * F.col("weight")).otherwise(F.col("limit"))
                               ).select("source", "source_size", "target")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def _held(item: Column, mass: Column) -> Column:
    return F.struct(item["doc_id"].alias("doc_id"), item["size"].alias("size"), item["copy"].alias("copy"),
                    mass.alias("mass"))


def _settled(item: Column, up) -> Column:
    return F.struct(item["doc_id"].alias("doc_id"), item["size"].alias("size"), item["copy"].alias("copy"),
                    F.lit(up).alias("up"))


def _exchange(state: Column, b: Column, seed: int) -> Column:
    """The next state: ``held`` carries words on, ``done`` lists the settled documents."""
    a = state["held"]
    step = F.struct(F.least(a["size"] - a["mass"], b["mass"]).alias("gain"),
                    F.least(a["mass"], b["size"] - b["mass"]).alias("loss"),
                    _uniform(F.lit(seed), a["doc_id"], a["copy"], b["doc_id"], b["copy"]).alias("u"))

    def settle(s: Column) -> Column:
        gains = s["u"] * (s["gain"] + s["loss"]) < s["loss"]
        a_full = s["gain"] == a["size"] - a["mass"]
        a_empty = s["loss"] == a["mass"]
        keeps_a = F.when(gains, ~a_full).otherwise(~a_empty)
        moved = F.when(gains, s["gain"]).otherwise(-s["loss"])
        held = F.when(keeps_a, _held(a, a["mass"] + moved)).otherwise(_held(b, b["mass"] - moved))
        # the one that is settled: a full or b full, else empty
        done = F.when(keeps_a, F.when(gains, _settled(b, False)).otherwise(_settled(b, True))).otherwise(
            F.when(gains, _settled(a, True)).otherwise(_settled(a, False)))
        return F.struct(held.alias("held"), F.concat(state["done"], F.array(done)).alias("done"))

    return F.when(a.isNull(), F.struct(_held(b, b["mass"]).alias("held"), state["done"].alias("done"))
                  ).otherwise(_let(step, settle))


STATE = ("struct<held: struct<doc_id: bigint, size: bigint, copy: bigint, mass: double>, "
         "done: array<struct<doc_id: bigint, size: bigint, copy: bigint, up: boolean>>>")


def round_fractions(items: DataFrame, seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """``source, doc_id, size, copy, up`` for ``items`` (``source, doc_id, size, copy, mass``).

    ``mass`` is the fraction times the size, over 0 and under the size; rows are distinct.
    """
    per_source = items.groupBy("source").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    most = per_source.agg(F.max("chunks")).first()[0] or 1
    level = (items.join(per_source, items.source.eqNullSafe(per_source.source)).drop(per_source.source)
             .withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "copy"), F.col("chunks"))))
    empty = F.from_json(F.lit('{"done": []}'), STATE)
    rounded = []
    while True:
        folded = stage(level.groupBy("source", "chunk").agg(F.array_sort(F.collect_list(
            F.struct("doc_id", "size", "copy", "mass"))).alias("items")).select(
            "source", "chunk", F.aggregate("items", empty, lambda s, b: _exchange(s, b, seed)).alias("state")),
            "exchanged")
        rounded.append(folded.select("source", F.explode("state.done").alias("d")).select("source", "d.*"))
        level = folded.select("source", F.floor(F.col("chunk") / chunk).alias("chunk"), "state.held.*")
        if most <= 1:
            break
        most = -(-most // chunk)
    last = level.select("source", "doc_id", "size", "copy", (_uniform(
        F.lit(seed), "doc_id", "size", "copy") * F.col("size") < F.col("mass")).alias("up"))
    for part in rounded:
        last = last.union(part)
    return last


def mix(docs: DataFrame, most: int = MOST_COPIES, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies``: how often the mix takes each row."""
    rows = stage(docs.select("doc_id", "source", words().alias("size"))
                 .groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "sized")
    targets = stage(source_targets(rows.select("source", (F.col("size") * F.col("rows")).alias("size")),
                                   most, weights), "targets")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    whole = F.floor(rate + 1e-9)
    units = (rows.select(F.col("source").alias("of"), "doc_id", "size",
                         F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
             .join(targets, F.col("of").eqNullSafe(F.col("source"))).drop("of")
             .withColumn("whole", whole).withColumn("part", rate - whole))
    broken = (F.col("part") > 1e-9) & (F.col("size") > 0)
    up = round_fractions(units.where(broken).select(
        "source", "doc_id", "size", "copy", (F.col("part") * F.col("size")).alias("mass")), seed)
    taken = up.select(F.col("source").alias("of"), "doc_id", "size", F.col("up").cast("long").alias("more"))
    rounded = taken.join(targets, F.col("of").eqNullSafe(F.col("source"))).drop("of").select(
        "doc_id", "source", "size", "source_size", "target", (whole + F.col("more")).alias("copies"))
    return rounded.union(units.where(~broken).select(
        "doc_id", "source", "size", "source_size", "target", F.col("whole").alias("copies")))


def taken_documents(docs: DataFrame, most: int = MOST_COPIES, weights: tuple[int, ...] = WEIGHTS,
                    seed: int = 7) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    size, nth, taken, again = (spare(name, docs) for name in ("size", "nth", "taken", "again"))
    key = ["doc_id", "source", "size"]
    order = Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"))
    number = Window.partitionBy(*key).orderBy("copies")
    copies = mix(docs, most, weights, seed).withColumn("nth", F.row_number().over(number)).where("copies > 0").select(
        F.struct(*key, "nth", "copies").alias(taken))
    rows = docs.withColumn(size, words()).withColumn(nth, F.row_number().over(order))
    same = F.col(nth) == F.col(f"{taken}.nth")
    for own, other in zip(("doc_id", "source", size), key):
        same = same & F.col(own).eqNullSafe(F.col(f"{taken}.{other}"))
    joined = rows.join(copies, same)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), f"{taken}.copies")).alias(again)
                         ).drop(again)
