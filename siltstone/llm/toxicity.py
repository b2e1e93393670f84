"""Toxicity by compression distance with two Zstandard dictionaries.

Words are recoded before anything is compressed: each byte of a word becomes two
bytes, a hash of the word up to there. Codes look random, so a word costs what
it is long unless a dictionary holds its beginning, and words that start alike
share code. One dictionary is trained on the whole texts of toxic documents, the
other on those of ordinary ones; both stand behind the same part trained on
further ordinary documents, so that words that both classes have cost the same.
A window with words that only the toxic dictionary knows compresses to fewer
bytes with it; the differences of a document's windows, over the whole text, are
summed up in a few numbers from which a logistic function, fitted on documents
that neither dictionary saw, makes the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontaminate import item_words
from .store import ship_code
from .words import BYTE_BASE, mix, powers, sliced, text_bytes

#: Labelled documents to train on at most (those with the smallest hashes of their ids), and bytes of one:
#: the driver holds 190 MB of text at most. They bound what is learnt from, not what is scored.
MAX_TOXIC, MAX_ORDINARY, MAX_BYTES = 4000, 8000, 16 << 10
#: Share of the ordinary training documents that the common part is trained on.
COMMON_SHARE = 0.8
#: Words in a window; bytes of the common part and of the two dictionaries, of which the calibration picks.
WINDOW, BASE_BYTES, OWN_BYTES = 16, (32768, 65536), (2048, 3072, 4096, 8192, 16384)
#: A document is called toxic from this score on.
THRESHOLD = 0.3
_STEPS = (3, 5, 8)
_SOME = 200  # training texts handled at a time


def _codes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-byte codes of all word bytes, where words begin in them (with the end), and each text's first word."""
    w = item_words(buf, offsets)
    n = len(w.buf)
    p = powers(BYTE_BASE, n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((w.buf.astype(np.uint64) + np.uint64(1)) * p.up[:n], out=sums[1:])
    size = w.ends - w.starts
    begin = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(w.starts, size)
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], size) + word
    h = mix((sums[at + 1] - sums[word]) * p.down[word])
    return (h >> np.uint64(48)).astype("<u2"), begin, w.first


def _windows(begin: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, bytes) of each window, and whose it is."""
    n = np.diff(first)
    k = -(-n // window)
    doc = np.repeat(np.arange(len(n)), k)
    lo = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)) * window
    hi = np.minimum(lo + window, first[doc + 1])
    return np.stack([2 * begin[lo], 2 * (begin[hi] - begin[lo])], 1).astype("<u8"), doc


def _dictionary(texts: list[str], size: int, window: int, segment: int) -> bytes:
    """Trained on windows of the recoded texts, and made exactly ``size`` bytes long."""
    samples: list[bytes] = []
    for i in range(0, len(texts), _SOME):
        codes, begin, first = _codes(*text_bytes(pa.array(texts[i : i + _SOME], pa.large_string())))
        raw = codes.tobytes()
        samples += [raw[a : a + n] for a, n in _windows(begin, first, window)[0].tolist() if n >= 8]
    try:
        data = zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on
        data = b"".join(samples)
    return data[-size:].rjust(size, b"\0")


@dataclass
class ToxicityModel:
    """The dictionaries and the calibration; small, and sent to tasks as it is."""

    toxic: bytes
    ordinary: bytes
    prior: float
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        how = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=17, chain_log=17, search_log=5, min_match=7, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        raw = zstandard.DICT_TYPE_RAWCONTENT
        return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=raw), compression_params=how) for d in (self.toxic, self.ordinary)]

    def features(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text: how the two compressed lengths differ over its windows."""
        codes, begin, first = _codes(buf, offsets)
        seg, doc = _windows(begin, first, WINDOW)
        n = len(first) - 1
        gain = np.zeros(len(seg))
        if len(seg):
            raw, lengths = zstandard.BufferWithSegments(codes.tobytes(), seg.tobytes()), []
            for c in self._compressors():
                out = c.multi_compress_to_buffer(raw, threads=1)
                lengths.append(np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out)))
            gain = (lengths[1] - lengths[0]).astype(float)
        count = np.maximum(np.bincount(doc, minlength=n), 1)
        most = np.zeros(n)
        np.maximum.at(most, doc, gain)

        def share(yes: np.ndarray) -> np.ndarray:
            return np.sqrt(np.bincount(doc, weights=yes, minlength=n) / count)

        return np.stack([np.bincount(doc, weights=gain, minlength=n) / count, most / 8, *(share(gain >= s) for s in _STEPS), share(gain <= -5), 1 / np.sqrt(count)], 1)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> float:
        """Fit the logistic function (ridge of 1, Newton steps); returns the log loss."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        a = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        w = np.zeros(a.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + np.eye(len(w))
            w += np.linalg.solve(h, a.T @ (y - p) - w)
        self.weights = w
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    def shift(self, share: float, true_share: float) -> None:
        """Move the scores from a sample with one share of toxic documents to a population with another."""
        if len(self.weights) and 0 < share < 1 and 0 < true_share < 1:
            self.weights[0] += np.log(true_share / (1 - true_share)) - np.log(share / (1 - share))

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(offsets) - 1, self.prior)
        x = self.features(buf, offsets)
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), (x - self.mean) / self.scale] @ self.weights, -30, 30)))


def train_model(toxic: list[str], ordinary: list[str], held: list[str], held_labels: list[int]) -> ToxicityModel:
    """Dictionaries from the first two lists, calibration on the third.

    Without toxic, ordinary or calibration texts the score of every text is the
    share of toxic ones among all given.
    """
    y = np.array(held_labels, float)
    prior = (len(toxic) + y.sum()) / max(1, len(toxic) + len(ordinary) + len(y))
    if not toxic or len(ordinary) < 2 or not len(y):
        return ToxicityModel(b"", b"", float(prior))

    cut = max(1, int(COMMON_SHARE * len(ordinary)))
    own = {n: [_dictionary(texts, n, WINDOW, 16) for texts in (toxic, ordinary[cut:])] for n in OWN_BYTES}
    best: tuple[float, ToxicityModel] | None = None
    for size in BASE_BYTES:
        base = _dictionary(ordinary[:cut], size, WINDOW, 32)
        for for_toxic, for_ordinary in own.values():
            model = ToxicityModel(base + for_toxic, base + for_ordinary, float(prior))
            parts = [model.features(*text_bytes(pa.array(held[i : i + _SOME], pa.large_string()))) for i in range(0, len(held), _SOME)]
            loss = model.calibrate(np.concatenate(parts), y)
            if best is None or loss < best[0]:
                best = (loss, model)
    return best[1]


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", held_out: int = 2) -> ToxicityModel:
    """A model from labelled documents whose fold isn't ``held_out``.

    At most MAX_TOXIC and MAX_ORDINARY labels, those with the smallest hashes of
    their ids, are joined to documents of at most MAX_BYTES; this bounds what is
    collected. Fold 3 calibrates, the others train; the share of toxic labels is
    taken from all rows. Labels that are null or have no document are left out,
    and so are ids that are labelled both ways; repeated labels count once. All
    documents of a labelled id are learnt from. Their order is that of the hashes,
    so that no part of the training is a range of ids. An empty table of either
    kind gives a model that scores every text alike.
    """
    rows = labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").withColumn("fold", fold("id")).where(F.col("fold") != held_out)
    rows = rows.groupBy("id", "fold").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    picked = None
    for y, most in ((1, MAX_TOXIC), (0, MAX_ORDINARY)):
        some = rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where(F.octet_length("t") <= MAX_BYTES).join(F.broadcast(picked), "id").select("id", "y", "fold", "t")  # bounded above
    found = [tuple(r)[1:] for r in sorted(texts.select(F.xxhash64("id").alias("h"), "id", "y", "fold", "t").collect())]
    calibrate = [r for r in found if r[2] == 3]
    model = train_model([r[3] for r in found if r[1] and r[2] != 3], [r[3] for r in found if not r[1] and r[2] != 3], [r[3] for r in calibrate], [r[1] for r in calibrate])
    share = rows.agg(F.avg("y").alias("s")).first()["s"] or 0.0
    model.shift(sum(r[1] for r in calibrate) / max(1, len(calibrate)), share)
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on).

    All windows of the whole text count. A null or wordless text has no windows
    and gets the score that the calibration gives to that. Repeated rows score
    alike. Input columns named like results are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_code(docs.sparkSession)
    docs = docs.drop(*[c for c in ("score", "predicted") if c in docs.columns and c != text])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sliced(batches, text, 2 << 20):
            s = model.scores(*text_bytes(t.column(text)))
            t = t.append_column("score", pa.array(s)).append_column("predicted", pa.array((s >= THRESHOLD).astype(np.int32)))
            yield from t.select(arrow.names).cast(arrow).to_batches()

    return docs.mapInArrow(run, schema)
