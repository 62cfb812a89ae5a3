"""Quality classifier: naive Bayes support vectors (NB-SVM).

Features are indicators of hashed n-grams: words, word pairs, character trigrams of a word's shape (letters to a / A,
digits to 0, the rest as it stands) and of its ends. Each is scaled by the log ratio of its smoothed document counts in
the two classes; a row is brought to unit length. A linear hinge-loss model is then fitted by dual coordinate descent,
and its margins are turned into probabilities by a logistic curve fitted on rows left out of the fit.

The fit reads a bounded sample of labelled documents: about `TRAIN_ROWS` for the class counts and about `MAX_ROWS` of
these for the hinge-loss model, those whose hash of doc_id lies lowest. The sample is chosen among numbers alone, so no
text but the sample's is ever moved. Scoring covers every row.

Null and empty texts have no features and get the score of the intercept. Rows that repeat a doc_id are scored each for
itself; the least of their texts teaches. Labels that are null, or for unknown documents, teach nothing; of several
labels for a document the greatest counts. With one class alone every score is its smoothed share, without any labels
0.5. An empty table gives an empty result. Texts may have any length: a long one makes a numpy pass of its own. Columns
other than doc_id, text and quality are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_names, shipped, slices, small_batches, tabled, tidied, totals, written
from .hashing import Words, distinct, mixed

FEATURE_BITS = 18
#: Labelled documents whose texts the class counts read, about; chosen by hash.
TRAIN_ROWS = 32768
#: Of these the rows that the hinge-loss model is fitted on, about.
MAX_ROWS = 6000
#: The fold of a document: crc32(doc_id as text) mod FOLDS; fold 0 is held out.
FOLDS = 5
CUT = 0.3
COST = 1.0
ALPHA = 1.0


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of all rows one after another, and where each row's begin and end."""
    words = Words(text)
    n_rows, n = len(text), len(words.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(n_rows + 1, np.int64)
    row = words.row_of()
    shape = np.arange(256, dtype=np.uint8)
    shape[ord("a") : ord("z") + 1], shape[ord("A") : ord("Z") + 1], shape[ord("0") : ord("9") + 1], shape[128:] = ord("a"), ord("A"), ord("0"), ord("a")
    data, hashed = words.data, words.hashes()
    shapes = shape[data].astype(np.uint64)
    last = len(data) - 1
    at = lambda i: shapes[np.clip(i, 0, last)]
    length = np.minimum(words.ends - words.starts, 24).astype(np.uint64)
    tail = at(words.ends - 1) + (at(words.ends - 2) << np.uint64(8)) + (at(words.ends - 3) << np.uint64(16))
    head = at(words.starts) + (at(words.starts + 1) << np.uint64(8))
    same = np.flatnonzero(row[1:] == row[:-1])
    kinds = [
        (hashed, row),
        (hashed[same] * np.uint64(3) + hashed[same + 1], row[same]),
        (tail + np.uint64(1 << 40), row),
        (head + np.uint64(2 << 40), row),
        ((tail << np.uint64(24)) + tail[np.minimum(np.arange(n) + 1, n - 1)] + np.uint64(3 << 56), row),
        (length + np.uint64(4 << 40), row),
    ]
    numbers = np.concatenate([mixed(x) >> np.uint64(64 - FEATURE_BITS) for x, _ in kinds]).astype(np.int64)
    rows = np.concatenate([r for _, r in kinds])
    keys = distinct((rows << FEATURE_BITS) | numbers)
    return keys & ((1 << FEATURE_BITS) - 1), np.searchsorted(keys >> FEATURE_BITS, np.arange(n_rows + 1))


def _lowest(rows: DataFrame, n: int, limit: int, turn: int) -> DataFrame:
    """Of n rows with distinct doc_id about `limit`, all if there are fewer: those with the lowest hashes of this turn."""
    if n <= limit:
        return rows
    return rows.filter(F.xxhash64("doc_id", F.lit(turn)) < F.lit(int(limit / n * 2.0**64) - 2**63))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> tuple[DataFrame, int]:
    """doc_id, text, label (0 or 1) of about `limit` labelled documents outside fold 0 as a table, and their number."""
    one = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    known = written(docs.filter(fold() != 0).select("doc_id").distinct().join(one, "doc_id"))
    chosen = F.broadcast(_lowest(known, known.count(), limit, 0))  # `limit` numbers, however many documents are labelled
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    rows = written(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    return rows, rows.count()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: in how many rows of each class each feature stands, and the rows of each class."""
    size = 1 << FEATURE_BITS
    counts, rows = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
    for part in slices(batches):
        numbers, ends = features(part.column(0))
        label = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(label, np.diff(ends))
        for k in (0, 1):
            counts[k] += np.bincount(numbers[of == k], minlength=size)
            rows[k] += int((label == k).sum())
    yield from tabled(np.concatenate([*counts, rows]))


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows (text, label) of each class each feature stands, and the rows of each class."""
    found = totals(rows.select("text", "label").mapInArrow(tidied(_count), "block int, counts binary"), (2 << FEATURE_BITS) + 2)
    return found[:-2].reshape(2, -1).astype(float), found[-2:]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        numbers, ends = features(part.column(0))
        numbers = numbers.astype(np.int32)
        yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([numbers[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["label", "doc_id", "features"])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L1-loss linear SVM; y is -1 or 1, cost the upper bound of each dual variable."""
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = y[i] * (float(w[x] @ v) + b) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                b += step
                alpha[i] = new
    return w, b


def _logistic(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))) by Newton steps with a little ridge."""
    theta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * theta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(hess, grad)
    return float(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model that labels (doc_id, quality) teach: weights over the features, intercept, logistic curve."""
    rows, n = training_rows(docs, labels)
    size = 1 << FEATURE_BITS
    counts, of_class = class_counts(rows)
    if not of_class.all():
        share = (of_class[1] + 1e-3) / (of_class.sum() + 2e-3)
        return {"weights": np.zeros(size, np.float32), "intercept": 0.0, "curve": (0.0, float(np.log(share / (1 - share))))}
    rate = [(counts[k] + ALPHA) / (of_class[k] + 2 * ALPHA) for k in (0, 1)]
    ratio = np.log(rate[1] / rate[0])
    ratio[counts.sum(0) == 0] = 0
    sample = _lowest(rows, n, MAX_ROWS, 1).select("text", "label", "doc_id")
    got = sorted(sample.mapInArrow(tidied(_sparse), "label int, doc_id long, features binary").collect(), key=lambda r: r.doc_id)
    x = [np.frombuffer(r.features, np.int32) for r in got]
    y = np.array([2 * r.label - 1 for r in got], np.float64)
    values = [(v := ratio[i]) / max(float(np.sqrt(v @ v)), 1e-9) for i in x]
    cost = COST * np.where(y > 0, 1.0, of_class[1] / of_class[0])
    part = np.arange(len(x)) % 3

    def fitted(use: np.ndarray):
        use = np.flatnonzero(use).tolist()
        return dual_coordinate_descent([x[i] for i in use], [values[i] for i in use], y[use], cost[use], size)

    margin = np.zeros(len(x))
    for k in range(3):
        w, b = fitted(part != k)
        for i in np.flatnonzero(part == k):
            margin[i] = float(w[x[i]] @ values[i]) + b
    w, b = fitted(part >= 0)
    return {"weights": (w * ratio).astype(np.float32), "ratio": ratio.astype(np.float32), "intercept": b, "curve": _logistic(margin, (y > 0).astype(float))}


def scores_of(text: pa.Array, model: dict) -> np.ndarray:
    weights, square = model["weights"].astype(np.float64), model.get("ratio", model["weights"]).astype(np.float64) ** 2
    a, b = model["curve"]
    numbers, ends = features(text)
    of = np.repeat(np.arange(len(text)), np.diff(ends))
    sums, norms = (np.bincount(of, x[numbers], minlength=len(text)) for x in (weights, square))
    margin = sums / np.sqrt(np.maximum(norms, 1e-12)) + model["intercept"]
    return 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, text) with score double. The model, 2 MB whatever the corpus, goes to the executors once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores_of(part.column(1), sent.value))], names=["doc_id", "score"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from labels (doc_id, quality) of rows outside fold 0."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


@plain_names("doc_id", "text")
def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score of CUT or more, with all their columns.

    The score is made beside the rows rather than joined to them: one pass, whatever doc_id holds.
    """
    model = fit(docs, labels)
    sent, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.schema.get_field_index("text")
            scores = np.concatenate([scores_of(part.column(text), sent.value) for part in slices([batch])] or [np.zeros(0)])
            yield batch.filter(pa.array(scores >= CUT))

    return small_batches(docs).mapInArrow(tidied(run), schema)


shipped(__name__)
