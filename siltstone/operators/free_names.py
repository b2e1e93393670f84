"""Names that are free when their turn comes, with a folder's rows in many tasks (SNK-21, SNK-22, D12).

A row asks for its stem, and where that is taken for the first free of stem_2, stem_3, ...
A name can only be taken by rows of two stems: its own (``x_2`` as it stands) and, if
it ends in a number, the stem before that (``x``). Of the first, all that the
second has to know is when its first row comes. So rows meet other rows only where
a stem and a numbered form of it are both asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .scans import sums_before

#: A stem that is another one with a number which that could come to; more digits than there can be rows don't matter.
NUMBERED = r"(?s)^(.+)_([2-9]|[1-9][0-9]{1,17})\z"


def _literal(rows: DataFrame) -> DataFrame:
    """Numbered stems whose stem is asked for too: _f, _s (the stem), _k (the number), _kid (the numbered stem), _at (its first order)."""
    stems = rows.groupBy("_f", "_s").agg(F.min(F.struct("_o")).getField("_o").alias("_at"))  # a null order is the first
    kids = stems.where(F.col("_s").rlike(NUMBERED)).select("_f", F.regexp_extract("_s", NUMBERED, 1).alias("_p"), F.regexp_extract("_s", NUMBERED, 2).cast("bigint").alias("_k"), F.col("_s").alias("_kid"), "_at")
    return kids.withColumnRenamed("_p", "_s").join(stems.select("_f", "_s"), ["_f", "_s"], "left_semi")


def _decided(kids: DataFrame) -> DataFrame:
    """``kids`` (_f, _s, _k, _kid, _room) with ``_own``: whether the numbered stem's first row gets the name, not a row of the stem.

    In ascending numbers it does if at most ``_room`` did so before it in its
    group. How many did is between those that are known to and those that aren't
    known not to; the smallest open number of a group is always decided, and all
    of them at once where names don't compete closely.
    """
    done, left = kids.where("_room < 0").withColumn("_own", F.lit(False)), kids.where("_room >= 0").withColumn("_own", F.lit(None).cast("boolean"))
    while True:
        own = F.col("_own")
        left = sums_before(left, ["_f", "_s"], ["_k"], _least=F.coalesce(own, F.lit(False)).cast("int"), _most=F.coalesce(own, F.lit(True)).cast("int"))
        now = F.when(own.isNotNull(), own).when(F.col("_most") <= F.col("_room"), True).when(F.col("_least") > F.col("_room"), False)
        left = checkpointed(left.withColumn("_own", now).drop("_least", "_most"))
        if left.where("_own IS NULL").isEmpty():
            return done.unionByName(left)


def unique_names(rows: DataFrame, folder: str, stem: str, order: str) -> DataFrame:
    """``name`` for each row, none twice in a folder: stem.md, or the first free stem_2.md, stem_3.md ... (SNK-22, D12).

    A null or empty stem is "output", null folders are one folder. In a folder
    rows come by order, of equal ones the smaller stem first; rows of one stem and
    order are in any order. Three passes, each with large groups in many tasks:
    places among the rows of a stem, which numbered stems come before the number
    is reached, and numbers that leave those out. Stems without a numbered form
    only take part in the first. Numbered forms of numbered forms take a round each.
    """
    f = F.coalesce(F.concat(F.lit("="), F.col(folder).cast("string")), F.lit("null"))
    s = F.coalesce(F.when(F.col(stem) != "", F.col(stem)), F.lit("output"))
    asked = rows.select(F.struct(*rows.columns).alias("_row"), f.alias("_f"), s.alias("_s"), F.col(order).alias("_o"))
    kids = checkpointed(_literal(asked))
    events = kids.withColumnsRenamed({"_at": "_o"}).withColumn("_event", F.lit(1))
    ranked = checkpointed(sums_before(asked.withColumn("_event", F.lit(0)).unionByName(events, True), ["_f", "_s"], ["_o", "_event"], _n=1 - F.col("_event")))
    placed, kids = ranked.where("_event = 0").select("_row", "_f", "_s", "_n"), ranked.where("_event = 1").select("_f", "_s", "_k", "_kid", "_n")

    def named(found: DataFrame) -> DataFrame:
        """found: _row, _s, _number (null: the stem as it is)."""
        name = F.concat("_s", F.when(F.col("_number").isNull(), "").otherwise(F.concat(F.lit("_"), F.col("_number").cast("string"))), F.lit(".md"))
        return found.select("_row.*", name.alias("name"))

    if kids.isEmpty():
        return named(placed.withColumn("_number", F.when(F.col("_n") > 0, F.col("_n") + 1)))

    # A generation's stems know whether their own names were taken by the stem before; that settles those of their numbered forms.
    now = kids.join(kids.select("_f", F.col("_kid").alias("_s")), ["_f", "_s"], "left_anti").withColumn("_lost", F.lit(False))
    settled = None
    while not now.isEmpty():
        before = F.when(F.col("_lost"), F.col("_n")).otherwise(F.greatest(F.col("_n") - 1, F.lit(0)))
        now = checkpointed(_decided(now.select("_f", "_s", "_k", "_kid", (F.col("_k") - 2 - before).alias("_room"))).select("_f", "_s", "_k", "_kid", "_own"))
        settled = now if settled is None else settled.unionByName(now)
        now = checkpointed(kids.join(now.select("_f", F.col("_kid").alias("_s"), (~F.col("_own")).alias("_lost")), ["_f", "_s"]))

    lost = settled.where("NOT _own").select("_f", F.col("_kid").alias("_s"), F.lit(1).alias("_lost"), F.lit(0).alias("_skips"))
    skips = settled.where("_own")
    about = lost.unionByName(skips.select("_f", "_s", F.lit(0).alias("_lost"), F.lit(1).alias("_skips"))).groupBy("_f", "_s").agg(F.max("_lost").alias("_lost"), F.max("_skips").alias("_skips"))
    # The place among the rows that need a number; below 0: the stem itself.
    placed = placed.join(about, ["_f", "_s"], "left").withColumn("_place", F.col("_n") - 1 + F.coalesce("_lost", F.lit(0)))
    plain = placed.where("coalesce(_skips, 0) = 0 OR _place < 0").select("_row", "_s", F.when(F.col("_place") >= 0, F.col("_place") + 2).alias("_number"))
    free = sums_before(skips.select("_f", "_s", "_k"), ["_f", "_s"], ["_k"], _q=F.lit(1)).select("_f", "_s", (F.col("_k") - 2 - F.col("_q")).alias("_place"), F.lit(0).alias("_event"))
    rest = placed.where("_skips = 1 AND _place >= 0").select("_row", "_f", "_s", "_place", F.lit(1).alias("_event"))
    rest = sums_before(rest.unionByName(free, True), ["_f", "_s"], ["_place", "_event"], _taken=1 - F.col("_event")).where("_event = 1")
    return named(plain.unionByName(rest.select("_row", "_s", (F.col("_place") + 2 + F.col("_taken")).alias("_number"))))
