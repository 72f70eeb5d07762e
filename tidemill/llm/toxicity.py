"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, one on ordinary text and one on toxic text. A text is cut at spaces into short windows,
and each is compressed with the ordinary dictionary and with that and the toxic one together: where the second is
clearly shorter, the window holds what only toxic text explains. The trainer picks what recurs, which in toxic text is ordinary
for the most part; so the toxic dictionary is pruned of strings that ordinary text holds about as often.

Thresholds on the window's gain are quantiles of all ordinary training windows; a logistic curve over a text's gains is fitted to
the training labels and calibrated to their true share. The fit uses a sample of at most `fit_rows` labelled texts of at most `fit_bytes` together, and all windows of these; scoring covers every window of every text.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, give_back, slices, small_batches, stored
from .kneser_ney import held_out_by

#: Values of a text's features, in order.
FEATURES = ["largest", "mean", "mean_of_largest_3", "share_over_first", "share_over_second", "log_over_first", "log_over_second", "log_windows", "sum", "sum_by_root"]

#: Matches are not looked for in a dictionary's last bytes.
PAD = b" " * 16


def windows(text: bytes, size: int) -> list[bytes]:
    """The lower-cased text, each run of white space one space, cut before spaces into windows of about size bytes."""
    t = b" " + b" ".join(text.lower().split())
    if len(t) <= size:
        return [t]
    spaces = np.append(np.flatnonzero(np.frombuffer(t, np.uint8) == 32), len(t))
    cut = np.unique(np.append(spaces[np.searchsorted(spaces, np.arange(0, len(t), size))], len(t))).tolist()
    return [t[a:b] for a, b in zip(cut, cut[1:])]


@dataclass
class Classifier:
    ordinary: bytes
    toxic: bytes
    size: int
    level: int
    thresholds: tuple[float, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features, then the constant

    def __post_init__(self) -> None:
        self._with: tuple | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_with"}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._with = None

    def gains(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        if self._with is None:
            self._with = _compressor(self.ordinary + PAD, self.level), _compressor(self.ordinary + self.toxic + PAD, self.level)
        a, b = (c.compress for c in self._with)
        return np.array([len(a(w)) - len(b(w)) for w in parts], np.float64)

    def features(self, g: np.ndarray) -> np.ndarray:
        """Of a text whose windows have these gains."""
        one, two = (g >= self.thresholds[0]).sum(), (g >= self.thresholds[1]).sum()
        top = np.partition(g, len(g) - 3)[-3:] if len(g) > 3 else g
        return np.array([g.max(), g.mean(), top.mean(), one / len(g), two / len(g), np.log1p(one), np.log1p(two), np.log(len(g)), np.clip(g.sum(), -64, 64), g.sum() / np.sqrt(len(g))])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = (np.array([self.features(self.gains(windows(t, self.size))) for t in texts]) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)))


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(level, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


def _trained(samples: list[bytes], size: int, k: int) -> bytes:
    """Content of a dictionary; too few samples to train on are the content themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit(texts: list[bytes], toxic: list[bool], share: float | None = None, *, size: int = 128, level: int = 12, ordinary_bytes: int = 64 << 10, toxic_bytes: int = 32 << 10, passes: int = 6, seed: int = 1) -> Classifier:
    """A classifier from labelled texts. share: the toxic texts' true share, if those given are not in proportion.

    All windows train the dictionaries, and thresholds and curve see all.
    Without texts of both kinds every score is that share (0 if it is not known).
    """
    rng = random.Random(seed)
    y = np.array(toxic, bool)
    share = (float(y.mean()) if len(y) else 0.0) if share is None else share
    if not y.any() or y.all():
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Classifier(b"", b"", size, level, (1.0, 2.0), np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.append(np.zeros(len(FEATURES)), np.log(p / (1 - p))))
    kinds = []
    for kind in (False, True):
        own = sorted({w for t, k in zip(texts, toxic) if k == kind for w in windows(t, size)})  # what copies repeat counts once
        rng.shuffle(own)
        kinds.append(own)
    plain, bad = kinds
    ordinary = _trained(plain, ordinary_bytes, 64)
    # strings that recur in toxic texts, and those of them that ordinary texts hold far less often
    found: set[bytes] = set()
    for _ in range(passes):
        rng.shuffle(bad)
        found.update(_trained(bad, toxic_bytes, 16).split())
    held = [Counter(), Counter()]
    for k, own in enumerate(kinds):
        for w in own:
            held[k].update(found.intersection(w.split()))
    n = [len(own) for own in kinds]
    kept = sorted((w for w in found if held[1][w] >= 3 and held[1][w] / n[1] > 8 * (held[0][w] + 0.5) / n[0]), key=lambda w: (held[1][w], w))
    kept = [w for w in kept if 20 * held[1][w] >= held[1][kept[-1]]]
    model = Classifier(ordinary, b" " + b" ".join(kept) + b" " if kept else b"", size, level, (1.0, 2.0), np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES) + 1))
    gains = [model.gains(windows(t, size)) for t in texts]
    first, second = np.quantile(np.concatenate([g for g, k in zip(gains, toxic) if not k]), [0.99, 0.999])
    model.thresholds = (max(2.0, float(first)), max(3.0, float(first) + 1, float(second)))
    x = np.array([model.features(g) for g in gains])
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    weight = np.where(y, share / y.sum(), (1 - share) / (~y).sum()) * len(y)
    model.weights = _logistic((x - model.mean) / model.scale, y.astype(float), weight)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    b, pull = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (weight * (y - p)) - pull * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit_sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, fold: int = 2, fit_rows: int = 10_000, fit_bytes: int = 64 << 20) -> tuple[list[bytes], list[bool], float | None]:
    """At most fit_rows labelled texts that are not held out, at most half of each kind: those with the least hash of the id; and the toxic share of all such rows.

    Of rows that share an id, the text with the least hash stands for all. Of these texts as many are taken, in the order of the ids' hashes, as have fit_bytes together.
    """
    rows = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out_by("_id", folds, fold)).distinct()
    counts = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    if not counts:
        return [], [], None
    chosen = None
    for label in (0, 1):
        least = rows.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows // 2)
        chosen = least if chosen is None else chosen.union(least)
    text = F.coalesce(F.col("_text"), F.lit(""))
    found = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(chosen), "_id")
    found = stored(found.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64(text).alias("h"), text.alias("t"))).alias("r")).select("_id", "_label", F.col("r.t").alias("_text"), F.xxhash64("_id").alias("_order")), "labelled")
    sizes = found.select("_order", F.octet_length("_text").alias("n")).orderBy("_order").toArrow()
    within = np.cumsum(sizes.column("n").to_numpy()) <= fit_bytes
    last = int(sizes.column("_order").to_numpy()[within].max(initial=-1 << 63))
    got = sorted(found.where(F.col("_order") <= last).toLocalIterator(), key=lambda r: (str(r["_id"]), r["_label"], r["_text"]))
    total = sum(counts.values())
    return [r["_text"].encode() for r in got], [r["_label"] == 1 for r in got], counts.get(1, 0) / total


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, fold: int = 2, threshold: float = 0.3, fit_rows: int = 10_000, fit_bytes: int = 64 << 20, **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out (crc32 of the id as text, modulo folds, is fold), score (0 to 1), predicted (1 if score >= threshold).

    Only texts bear upon a score. Null and empty texts are one empty window and get its score. Repeated rows and equal texts get
    equal scores. Labels that are null or neither 0 nor 1, and rows without an id, teach nothing; without labels of both kinds every score is
    their share. An empty docs gives an empty result.
    """
    model = fit(*fit_sample(docs, labels, id_col=id_col, text_col=text_col, folds=folds, fold=fold, fit_rows=fit_rows, fit_bytes=fit_bytes), **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            score = shared.value.scores(binary(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out_by(id_col, folds, fold).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", threshold: float = 0.3, fit_rows: int = 10_000, fit_bytes: int = 64 << 20, **options) -> DataFrame:
    """docs, all columns, without the rows that score_toxicity() predicts to be toxic.

    Null and empty texts stay or go alike, as an empty window scores; so do repeated rows, and equal texts. An empty docs gives an empty result, and
    without labels of both kinds all rows get the labels' share as their score.
    """
    model = fit(*fit_sample(docs, labels, text_col=text_col, fit_rows=fit_rows, **options))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield part.filter(pa.array(shared.value.scores(binary(part.column(text_col))) < threshold))
        give_back()

    return docs.mapInArrow(run, schema)
