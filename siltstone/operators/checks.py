"""Checks of translations, assets and inputs (JOIN-01 to 09, JOIN-12, JOIN-15, AGG-12 to 15, SNK-30/31, SET-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import once, placeholder_error


def translation_errors(slots: DataFrame, translations: DataFrame, slot: str = "id", tags: str = "tags", text: str = "translation") -> DataFrame:
    """Rows (id, error): unknown ids, ids given twice, blank texts and wrong placeholders."""
    unknown = translations.join(slots, slot, "left_anti").select(slot, F.lit("unknown").alias("error")).distinct()
    twice = translations.groupBy(slot).agg(F.count("*").alias("n")).where("n > 1").select(slot, F.lit("duplicate").alias("error"))
    both = translations.join(slots.select(slot, tags), slot)
    blank = both.where(F.trim(F.coalesce(text, F.lit(""))) == "").select(slot, F.lit("blank").alias("error")).distinct()
    wrong = both.where(F.trim(F.coalesce(text, F.lit(""))) != "").where(placeholder_error(F.col(text), F.col(tags)).isNotNull()).select(slot, F.lit("placeholders").alias("error")).distinct()
    return unknown.unionByName(twice).unionByName(blank).unionByName(wrong)


def accepted(slots: DataFrame, translations: DataFrame, slot: str = "id", tags: str = "tags", text: str = "translation", allow_missing: bool = True) -> DataFrame:
    """The translations that can be used: of a known slot, not blank, with all placeholders in order (TXT-30).

    Where placeholders are wrong the slot counts as not translated, or, without
    ``allow_missing``, the whole set is refused with an error.
    """
    both = translations.join(slots.select(slot, tags), slot).where(F.trim(F.coalesce(text, F.lit(""))) != "")
    fits = (F.col(tags) <= 0) | placeholder_error(F.col(text), F.col(tags)).isNull()
    if not allow_missing and (wrong := [r[slot] for r in both.where(~fits).select(slot).limit(10).collect()]):
        raise ValueError(f"wrong placeholders in {wrong}")
    return both.where(fits).select(*translations.columns)


def missing(slots: DataFrame, translations: DataFrame, slot: str = "id") -> DataFrame:
    """The slots without a translation."""
    return slots.join(translations.select(slot), slot, "left_anti")


def apply_translations(slots: DataFrame, translations: DataFrame, slot: str = "id", source: str = "source", text: str = "translation") -> DataFrame:
    """Every slot with its translation, or its source where there is none."""
    one = translations.groupBy(slot).agg(F.min(text).alias(text))
    return slots.join(one, slot, "left").withColumn(text, F.coalesce(text, source))


def completeness(slots: DataFrame, translations: DataFrame, slot: str = "id", show: int = 20) -> DataFrame:
    """One row: total, translated, missing and the first missing ids."""
    have = translations.select(slot).distinct().withColumn("_have", F.lit(1))
    rows = slots.join(have, slot, "left")
    some = rows.where("_have IS NULL").orderBy(slot).limit(show).agg(F.sort_array(F.collect_list(slot)).alias("first_missing"))
    totals = rows.agg(F.count("*").alias("total"), F.count("_have").alias("translated"))
    # Both sides are single rows.
    return totals.withColumn("missing", F.col("total") - F.col("translated")).withColumn("_one", F.lit(1)).join(some.withColumn("_one", F.lit(1)), "_one").drop("_one")


def asset_uses(files: DataFrame, references: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """Files with how often and where they are referred to, unused ones with 0 (JOIN-07)."""
    used = references.groupBy(name).agg(F.count("*").alias("usage_count"), F.sort_array(F.collect_list(order)).alias("occurrences"))
    return files.join(used, name, "left").withColumns({"usage_count": F.coalesce("usage_count", F.lit(0)).cast("bigint"), "occurrences": F.coalesce("occurrences", F.array().cast("array<bigint>"))})


def unlisted(files: DataFrame, manifest: DataFrame, name: str = "name") -> DataFrame:
    """Files that a manifest lacks (SNK-31, SET-05)."""
    return files.join(manifest.select(name), name, "left_anti")


def spine_documents(spine: DataFrame, items: DataFrame) -> DataFrame:
    """Hrefs of a package in reading order, each once: spine (book, ord, idref) and manifest items (book, id, href)."""
    hit = spine.join(items, (spine["book"] == items["book"]) & (spine["idref"] == items["id"]))
    return hit.groupBy(spine["book"], "href").agg(F.min("ord").alias("ord"))


def broken_items(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Manifest items whose file isn't in the archive: items (book, id, path), entries (book, path)."""
    return items.join(entries, ["book", "path"], "left_anti")


def first_candidate(wanted: DataFrame, available: DataFrame, key: str, candidates: str, path: str = "path") -> DataFrame:
    """Of ordered candidate paths the first that is available; null where none is (JOIN-12)."""
    tried = wanted.select(key, F.posexplode(candidates).alias("pos", path))
    found = tried.join(available.select(path).distinct(), path).groupBy(key).agg(F.min_by(path, "pos").alias("found"))
    return wanted.join(found, key, "left")


def matched_occurrences(images: DataFrame, places: DataFrame, group: str = "doc") -> DataFrame:
    """Images and places one to one: the n-th of a hash with the n-th place of it, the rest by position.

    images (doc, ord, hash) and places (doc, pos, hash). Both rounds are joins on
    ranks; what is left over has a null partner (JOIN-08).
    """
    a = images.withColumn("k", F.row_number().over(Window.partitionBy(group, "hash").orderBy("ord")))
    b = places.withColumn("k", F.row_number().over(Window.partitionBy(group, "hash").orderBy("pos")))
    same = a.join(b.select(group, "hash", "k", "pos"), [group, "hash", "k"], "left")
    done = same.where("pos IS NOT NULL")
    free = b.join(done.select(group, "pos"), [group, "pos"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("pos")))
    open_ = same.where("pos IS NULL").drop("pos").withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("ord")))
    rest = open_.join(free.select(group, "r", "pos"), [group, "r"], "left")
    return done.select(group, "ord", "hash", "pos").unionByName(rest.select(group, "ord", "hash", "pos"))


def outcomes(results: DataFrame, group: str, status: str = "status") -> DataFrame:
    """Per group the numbers of successes, failures and skipped inputs."""
    kinds = ("success", "failed", "skipped")
    return results.groupBy(group).agg(*[F.count_if(F.col(status) == k).alias(k) for k in kinds])


def merged_options(defaults: Column, own: Column) -> Column:
    """Options with an item's own ones over the defaults, whatever the session does with keys that occur twice (JOIN-15)."""
    kept = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k))
    return F.map_concat(kept, own)


def last_values(names: Column, values: Column) -> Column:
    """A map in which the last value of a name counts (AGG-15)."""
    def last(pairs: Column) -> Column:
        by_name = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), (-i).alias("j"), p["v"].alias("v"))))
        kept = once(by_name, lambda s: F.filter(s, lambda p, i: F.coalesce(F.get(s, i - 1)["k"] != p["k"], F.lit(True))))
        placed = F.array_sort(F.transform(kept, lambda p: F.struct((-p["j"]).alias("i"), p["k"].alias("k"), p["v"].alias("v"))))
        return F.transform(placed, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))

    return F.map_from_entries(once(F.arrays_zip(names.alias("k"), values.alias("v")), last))
