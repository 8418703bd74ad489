"""Quality classifier: ordinal cumulative-link regression on hashed text.

A document has grade k or more with probability sigmoid(score - threshold_k):
one weight vector over hashed words and word shapes is shared by all grades,
and the thresholds are ordered.  The expected grade and the tail
probabilities P(grade >= k) serve for selection.

Features are sets.  A word counts once per document, lower-cased and without
the signs around it.  The shape of a word (runs of small letters, capitals,
digits; signs as they are) counts by its share of the words, in steps; so do
words that repeat the one before.  Weights are fitted with an L1 penalty, so
words without evidence have none and long documents gather no noise.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18                        # 2**BITS weights
MAX_RATED = 12_000               # rated documents used for the fit, the first by a hash of their id
PENALTY = 1e-4
ROUNDS = 300
CACHED_WORDS = 100_000
STEPS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)
_SIGNS = string.punctuation + "“”„‘’«»…–—¿¡"
_RUN = re.compile(r"(.)\1+", re.S)
_words: dict[str, tuple[int, str]] = {}


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _shape(word: str) -> str:
    return _RUN.sub(r"\1", "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c for c in word))


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature slots of a whole text; an empty text has one."""
    words = (text or "").split()
    if not words:
        return np.array([_slot("\x00empty")], dtype=np.int32)
    out: set[int] = set()
    shapes: Counter = Counter()
    for word, n in Counter(words).items():
        known = _words.get(word)
        if known is None:
            if len(_words) >= CACHED_WORDS:
                _words.clear()
            known = _slot(word.lower().strip(_SIGNS) or word), _shape(word)
            if len(word) <= 40:
                _words[word] = known
        out.add(known[0])
        shapes[known[1]] += n
    shapes["\x00again"] = sum(map(str.__eq__, words, words[1:]))
    shapes["\x00caps"] = sum(n for s, n in shapes.items() if "A" in s and "a" not in s)
    shapes["\x00signs"] = sum(n for s, n in shapes.items() if len(s) > 1 and s[-1] not in "aA0.,;:?)\"'»”")
    for shape, n in shapes.items():
        for k, step in enumerate(STEPS):
            if n < step * len(words):
                break
            out.add(_slot(f"\x00{k}{shape}"))
    return np.array(sorted(out), dtype=np.int32)


@dataclass
class Model:
    """Weights and ascending thresholds; ``thresholds[k-1]`` parts grades
    below k from k and more.  No thresholds: nothing was rated."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """(documents, grades - 1): P(grade >= 1), P(grade >= 2), ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, penalty: float = PENALTY, rounds: int = ROUNDS) -> Model:
    """Accelerated proximal gradient on the mean negative log-likelihood."""
    if not len(rows) or len(set(grades.tolist())) < 2:
        return Model(np.zeros(1 << BITS), np.zeros(0))
    slot, flat = np.unique(np.concatenate(rows), return_inverse=True)
    sizes = np.array([len(r) for r in rows])
    at = np.cumsum(sizes) - sizes
    n, d = len(rows), len(slot)
    seen = np.bincount(flat, minlength=d)
    scale = 1 / np.sqrt(np.maximum(seen, 1) / n + 0.01)      # frequent features move less
    scale /= scale.max()
    data = scale[flat]
    share = np.array([(grades >= k).mean() for k in range(1, n_grades)])
    theta = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    theta = np.maximum.accumulate(theta + np.arange(len(theta)) * 1e-3)
    v = np.ones(d)                               # largest curvature of the loss
    for _ in range(20):
        v = np.bincount(flat, weights=data * np.repeat(np.add.reduceat(data * v[flat], at), sizes), minlength=d) / n
        top = np.linalg.norm(v)
        v /= top
    rate = 1 / (0.25 * top + 1e-9)
    w = z = np.zeros(d)
    momentum = 1.0
    for _ in range(rounds):
        score = np.add.reduceat(data * z[flat], at)
        edges = np.concatenate([np.full((n, 1), np.inf), score[:, None] - theta[None, :], np.full((n, 1), -np.inf)], axis=1)
        s = 1 / (1 + np.exp(-np.clip(edges, -40, 40)))
        s[:, 0], s[:, -1] = 1, 0
        above, below = s[np.arange(n), grades], s[np.arange(n), grades + 1]
        pull = 1 - above - below                 # derivative of the log-likelihood by the score
        slope = s * (1 - s)
        p = np.maximum(above - below, 1e-9)
        by_theta = np.array([(slope[grades == k - 1, k] / p[grades == k - 1]).sum() - (slope[grades == k, k] / p[grades == k]).sum() for k in range(1, n_grades)]) / n
        step = z + rate * np.bincount(flat, weights=data * np.repeat(pull, sizes), minlength=d) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        momentum, last = (1 + np.sqrt(1 + 4 * momentum**2)) / 2, momentum
        z = new + (last - 1) / momentum * (new - w)
        w = new
        theta = np.maximum.accumulate(theta + by_theta)
        theta[1:] = np.maximum(theta[1:], theta[:-1] + 1e-6)
    weights = np.zeros(1 << BITS)
    weights[slot] = w * scale
    return Model(weights, theta)


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, max_rated: int = MAX_RATED) -> Model:
    """Fit on the rated documents: ``ratings`` (doc_id, grade), grades
    0 .. n_grades - 1.  At most ``max_rated`` ids take part, the first by a
    hash of the id; of several ratings of an id the lowest counts; null ids
    and grades are left out.  The bounded id list is what is broadcast, and
    only these documents' feature slots come to the driver."""
    picked = (ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated))
    rated = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "grade", "text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in slots], pa.binary())], names=["doc_id", "grade", "slots"])

    got = rated.select("doc_id", F.col("grade").cast("int").alias("grade"), "text").mapInArrow(run, "doc_id long, grade int, slots binary").toArrow().sort_by("doc_id")
    rows = [np.frombuffer(b, dtype=np.int32) for b in got.column("slots").to_pylist()]
    return fit(rows, np.array(got.column("grade").to_pylist(), dtype=np.int64), n_grades)


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``expected_grade`` (null without a fitted model) and
    ``tails``, the array of P(grade >= k).  Columns of these names are
    replaced.  Null text counts as empty; repeated rows get equal values."""
    held = docs.sparkSession.sparkContext.broadcast(model)   # fixed size: 2**BITS weights
    fields = [f for f in docs.schema.fields if f.name not in ("expected_grade", "tails") and (keep_text or f.name != text)]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "expected_grade double", "tails array<double>"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            scores = np.array([m.weights[features(t)].sum() for t in batch.column(text).to_pylist()])
            tails = m.tails(scores)
            expected = pa.array(tails.sum(axis=1)) if len(m.thresholds) else pa.nulls(len(scores), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), expected, pa.array(list(tails), pa.list_(pa.float64()))], names=[*names, "expected_grade", "tails"])

    return docs.mapInArrow(run, schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from the label table: 0 poor, 1 good but toxic, 2 good and not
    known as toxic."""
    return labels.where("doc_id is not null and quality is not null").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))


N_GRADES = 3
KEEP_TAIL = 0.5                  # keep where P(highest grade) is at least this


def keep(tails="tails"):
    """Column: selected.  Everything is kept when nothing was rated."""
    last = F.try_element_at(F.col(tails), F.lit(-1))
    return F.coalesce(last >= KEEP_TAIL, F.lit(True))
