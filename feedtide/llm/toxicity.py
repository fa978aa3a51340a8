"""Toxicity by compression distance (operator 4).

Two zstandard dictionaries are trained: one on windows of ordinary text, one on the same plus what toxic texts say and
ordinary ones don't (words whose document counts differ by a likelihood-ratio test). A window that compresses better
with the toxic dictionary speaks against its document. Since the dictionaries share their ordinary part, windows of
ordinary text come out alike. Gains of all windows of a text are summed up in six numbers, a logistic model on
labelled rows that no dictionary saw turns them into a score, and the threshold of best F1 that leaves all but
``MOST_CLEAN`` of the ordinary rows alone is moved to 0.5.

Models learn from at most ``per_class`` labelled rows of each class, taken in hash order, and never from held-out rows
(see ``common.held_out``). Label, language, source and doc_id are no inputs of a score.

Defined results: null and empty texts have no windows and get the score of a text without gains; a null ``doc_id``
counts as held out; a doc_id labelled more than once is toxic if any label says so; null labels are no labels; without
labels of both classes every score is 0. Repeated rows are scored each for itself, whole texts however long.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedtide.llm.common import columns_apart, hash_order, held_out, kept_in_worker, map_texts

WINDOW_WORDS = 6
#: Optimal parsing and matches from 3 bytes on: windows are short, and so are words.
PARAMETERS = {
    "window_log": 15, "chain_log": 14, "hash_log": 14, "search_log": 4, "min_match": 3, "target_length": 16,
    "strategy": zstandard.STRATEGY_BTOPT, "write_checksum": 0, "write_content_size": 0, "write_dict_id": 0,
}
DICTIONARY_BYTES = 8192
#: How far the likelihood-ratio statistic of a toxic text's own word is above what chance gives the best of all words.
EXTRA_EVIDENCE = 6.0
MOST_WORDS = 200
FEATURES = 6
#: Part of the ordinary calibration rows that may be taken for toxic.
MOST_CLEAN = 0.01


def windows(text: str) -> list[bytes]:
    words = text.lower().split()
    return [" ".join(words[i : i + WINDOW_WORDS]).encode() for i in range(0, len(words), WINDOW_WORDS)]


def _evidence(a: int, b: int, share: float) -> float:
    """Likelihood-ratio statistic of a word in ``a`` toxic and ``b`` ordinary texts.

    ``share`` is that of toxic texts among all. 0 if the word isn't twice as frequent in toxic ones as in ordinary ones.
    """
    if a * (1 - share) <= 2 * b * share:
        return 0.0
    expected = share * (a + b)
    return 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0.0))


def _own_words(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Words that toxic texts hold far more often than ordinary ones, best evidence first.

    A text counts for a word if most words that precede it there preceded it in no text before, so a text and its copies
    count once. Compression finds a word inside longer ones as well, so the words with the best evidence are counted
    once more as parts of the texts. What counts as evidence grows with the number of words that chance could favour.
    """
    share = len(toxic) / (len(toxic) + len(ordinary))
    both = [[" ".join(t.lower().split()) for t in texts] for texts in (toxic, ordinary)]
    counts = []
    for texts in both:
        met: set[tuple[str, str]] = set()
        seen: Counter[str] = Counter()
        for text in texts:
            words = [w.strip(".,;:!?\"'()") for w in text.split()]
            pairs = set(zip(words[1:], words))
            fresh = Counter(w for w, _ in pairs - met)
            every = Counter(w for w, _ in pairs)
            seen.update(w for w, n in fresh.items() if 2 * n > every[w])
            met |= pairs
        counts.append(seen)
    least = 2 * math.log(1 + len(counts[0])) + EXTRA_EVIDENCE
    found = [(_evidence(a, counts[1][w], share), w) for w, a in counts[0].items() if len(w) > 2]
    found = [w for evidence, w in sorted(found, reverse=True)[:MOST_WORDS] if evidence >= least]

    def inside(word: str) -> float:
        pattern, holds = re.compile(re.escape(word)), []
        for texts in both:
            met, n = set(), 0
            for text in texts:
                near = {text[max(0, m.start() - 8) : m.start()] for m in pattern.finditer(text)}
                n += 2 * len(near - met) > len(near)
                met |= near
            holds.append(n)
        return _evidence(*holds, share)

    return [w for evidence, w in sorted(((inside(w), w) for w in found), reverse=True) if evidence >= least]


@dataclass
class Model:
    """Two dictionaries and the weights of 1 and the features."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def compressors(self):
        made = []
        for content in (self.ordinary, self.toxic):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
            parameters = zstandard.ZstdCompressionParameters(**PARAMETERS)
            dictionary.precompute_compress(compression_params=parameters)
            made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress)
        return made

    @staticmethod
    def features(text: str, ordinary, toxic) -> tuple[float, ...]:
        """How many windows gain three bytes or more, two or more, one, or lose; how many there are; the largest gain."""
        gains = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], np.int64)
        if not len(gains):
            return (0.0,) * FEATURES
        numbers = ((gains > 2).sum(), (gains > 1).sum(), (gains == 1).sum(), (gains < 0).sum(), len(gains))
        return (*(math.log1p(n) for n in numbers), float(min(max(gains.max(), 0), 6)))

    def score(self, features: np.ndarray) -> np.ndarray:
        logits = np.clip(self.weights[0] + features @ np.array(self.weights[1:]), -30, 30)
        return 1 / (1 + np.exp(-logits))


def _logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.r_[0.0, np.ones(len(w) - 1)]
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, x.T @ (labels - p) - penalty * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return w


def fit(rows: list[tuple[str, int]], seed: int = 1) -> Model | None:
    """A model from (text, toxic) rows: two thirds make the dictionaries, the others the weights."""
    rows = sorted(rows)
    random.Random(seed).shuffle(rows)
    parts = [[t for i, (t, y) in enumerate(rows) if y == label and i % 3 < 2] for label in (1, 0)]
    if not all(parts):
        return None
    toxic, ordinary = parts
    sample = [w for t in ordinary for w in windows(t)]
    random.Random(seed).shuffle(sample)
    sample = sample[:40_000]
    if len(sample) > 1000:
        core = zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    else:  # too little to train on: the text itself
        core = b" ".join(sample)[:DICTIONARY_BYTES]
    own = _own_words(toxic, ordinary)
    rest = [(t, y) for i, (t, y) in enumerate(rows) if i % 3 == 2]
    labels = np.array([y for _, y in rest], float)
    if not len(labels) or labels.min() == labels.max():
        return None
    # How much of the toxic text's own goes into its dictionary is what tells the classes apart best.
    tried = []
    for n in sorted({min(n, len(own)) for n in (5, 10, 20, 40, 80, MOST_WORDS)}):
        model = Model(core, core + "".join(f" {w} " for w in reversed(own[:n])).encode(), ())
        pair = model.compressors()
        features = np.array([Model.features(t, *pair) for t, _ in rest]).reshape(-1, FEATURES)
        weights = _logistic(features, labels)
        p = 1 / (1 + np.exp(-np.clip(weights[0] + features @ weights[1:], -30, 30)))
        tried.append((-float(np.log(np.where(labels == 1, p, 1 - p)).mean()), n, model, features, weights))
    _, _, model, features, weights = min(tried, key=lambda x: x[:2])
    logits = weights[0] + features @ weights[1:]
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    clean = np.cumsum(1 - labels[order]) / max(1, (1 - labels).sum())
    ends = np.r_[np.diff(logits[order]) != 0, True]  # a threshold takes all rows of one logit or none
    able = ends & (clean <= MOST_CLEAN)
    if able.any():
        best = int(np.argmax(np.where(able, f1, -1)))
        below = logits[order][best + 1] if best + 1 < len(order) else logits[order][best] - 1
        weights[0] -= (logits[order][best] + below) / 2
    else:
        weights[0] -= logits.max() + 1
    return Model(core, model.toxic, tuple(float(w) for w in weights))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Model | None:
    """Fit on at most ``per_class`` labelled rows of each class."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label in (0, 1):
        own = known.where(F.col("toxic") == label).orderBy(*hash_order("doc_id")).limit(per_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    # At most 2 * per_class ids, hence a broadcast; of texts that share a doc_id, the one of the least hash.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return fit([(r.text, int(r.toxic)) for r in texts.collect()])


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` for every row."""

    def work(texts, batch):  # the model is two dictionaries of 8 KB, so it travels with the function
        if model is None:
            return [pa.array(np.zeros(len(texts)))]
        key = f"toxicity {zlib.crc32(model.ordinary)} {zlib.crc32(model.toxic)}"
        pair = kept_in_worker(key, model.compressors)
        features = np.array([Model.features(t, *pair) for t in texts]).reshape(-1, FEATURES)
        return [pa.array(model.score(features))]

    return map_texts(docs, list(keep), "score double", work)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    scored = score(docs, learn(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@columns_apart
def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns."""
    columns = docs.columns
    scored = score(docs, learn(docs, labels), keep=tuple(columns))
    return scored.where(F.col("score") < 0.5).select(*columns)
