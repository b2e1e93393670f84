"""Spelling variants: words one edit apart, found with a rare-first q-gram prefix filter.

The bigrams of a word stand at positions. Over all words bigrams are ordered by
how many words have them, rarest first. One edit destroys at most two bigrams of a
word, so of the three rarest bigrams of either word one is left in the other one,
and among its three rarest, if all places of the third bigram count: the
argument is that of prefix filters, and needs an order of bigrams, not of places.
The bigram left stands at the same position from the start, if the edit comes
after it, or from the end, if the edit comes before. So the position limit is
made part of the join: words meet by the bigram with all that stands on the far
side of the edit. What stands on the edit's own side has the edit in its first or
in its second half, and the other half is part of the key as well. Words that meet
are verified by their edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import scratch, ship_code, written

LEAST_LENGTH, LEAST_COUNT, RATIO, PREFIX = 7, 2, 10, 3
#: A-Z, a-z and U+00C0 to U+00FF: 26 + 64 different characters after lower-casing, so 8100 bigrams at most.
LETTERS = r"a-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(doc_id: Column, word: Column, every: int = 31) -> Column:
    """The word, without one code point where ``every`` divides the checksum of the document's id and the word."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(F.pmod(h, F.lit(every)) == 0, shorter).otherwise(word)


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Distinct words (word, n) of all texts that are long and frequent enough."""
    # A shorter run can't become a word, as nothing is ever added to it.
    runs = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(f"([{LETTERS}]{{{least_length},}})"), F.lit(1))
    words = docs.select(F.col(doc_id).alias("d"), F.explode(runs).alias("w")).select(damaged(F.col("d"), F.col("w")).alias("word"))
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """The rank of every bigram by the number of its places in words, rarest first; 8100 at most come to the driver."""
    places = F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")
    rows = words.select(F.explode(places).alias("g")).groupBy("g").count().orderBy("count", "g").collect()
    return {r["g"]: i for i, r in enumerate(rows)}


def _half_keys(rest: str, longest: int) -> tuple[str, str]:
    """Of the two, one is equal for two rests that are one edit apart, the longer one having ``longest`` code points."""
    h = longest // 2
    return rest[:h], rest[len(rest) - (longest - 1 - h) :] if longest - 1 > h else ""


def join_keys(word: str, order: dict[str, int]) -> list[tuple[int, bool]]:
    """Keys by which the word meets all others one edit apart, and whether it is there as the shorter one.

    Two words one edit apart have a key in common at which at most one is there as
    the shorter one: neither if they are equally long, else the one that is.
    """
    at = sorted(range(len(word) - 1), key=lambda i: (order[word[i : i + 2]], i))
    last = order[word[at[PREFIX - 1] : at[PREFIX - 1] + 2]]
    out = set()
    for i in at:
        if order[word[i : i + 2]] > last:
            break
        for side, same, rest in (("r", word[: i + 2], word[i + 2 :]), ("l", word[i:], word[:i])):
            for shorter in (False, True):
                longest = len(rest) + shorter
                if longest:  # where nothing stands, nothing was edited
                    for which, half in zip("ab", _half_keys(rest, longest), strict=True):
                        out.add((xxhash.xxh64_intdigest(f"{side}{which}{longest} {same} {half}") - (1 << 63), shorter))
    return sorted(out)


KEYED = T.StructType([T.StructField("key", T.LongType()), T.StructField("shorter", T.BooleanType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


def _keyed(batches: Iterator[pa.RecordBatch], order: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):  # some 25 rows come of each
            b = batch.slice(lo, 2000)
            words = b.column(b.schema.get_field_index("word"))
            found = [join_keys(w, order) for w in words.to_pylist()]
            at = pa.array([i for i, keys in enumerate(found) for _ in keys], pa.int32())
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array([k for keys in found for k, _ in keys], pa.int64()),
                    "shorter": pa.array([s for keys in found for _, s in keys], pa.bool_()),
                    "word": words.take(at),
                    "n": b.column(b.schema.get_field_index("n")).take(at),
                }
            )


def near_words(words: DataFrame) -> DataFrame:
    """Distinct pairs (a, na, b, nb) of words that are one edit apart, each once. Words must have four code points or more."""
    order = bigram_order(words)
    keyed = written(words.mapInArrow(lambda b: _keyed(b, order), KEYED), "keyed-words")
    a = keyed.where("NOT shorter").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    b = keyed.select("key", "shorter", F.col("word").alias("b"), F.col("n").alias("nb"))
    met = a.hint("merge").join(b, "key").where((F.col("shorter") & (F.length("a") > F.length("b"))) | (~F.col("shorter") & (F.col("a") < F.col("b"))))
    return written(met.where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb").distinct(), "near-words")


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of the words that have a form: each round a word takes the end of its end's path.

    Counts grow tenfold with each form, so there are few steps and no circles.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = written(now.hint("merge").join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ratio: int = RATIO) -> DataFrame:
    """Per word: word, n, n_near, form, form_n and root.

    A word's form is its most frequent near word (ties: the first in code-point
    order), if that is at least ``ratio`` times as frequent; root is the end of the
    path of forms, or the word itself. Null and empty texts have no words; a row
    without an id counts as one with an empty id; repeated rows count repeatedly.
    An empty table gives an empty result. Only the two columns named are read.
    """
    ship_code(docs.sparkSession)
    with scratch() as keep:
        words = written(word_counts(docs, text, doc_id), "words")
        pairs = near_words(words)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
        best = F.min(F.struct((-F.col("nb")).alias("n"), F.col("b").alias("word")))
        near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
        out = words.hint("merge").join(near, "word", "left")
        enough = -F.col("best.n") >= ratio * F.col("n")
        out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"))
        out = written(out, "forms")
        ends = roots(out.where("form IS NOT NULL"))
        full = out.hint("merge").join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
        full = written(full.select("word", "form", "root", "n", "n_near", "form_n"), "spelling-variants")
        keep.append(full)
    return full
