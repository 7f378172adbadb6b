"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Indicators are word n-grams and n-grams of word shapes (case, closing marks, whether the word
repeats the one before), hashed to a fixed number of columns.  Columns are scaled by the log
ratio of their smoothed counts in the two classes; a linear hinge-loss model is then fitted by
dual coordinate descent and drawn towards its mean magnitude.  Margins of models fitted on
one half and applied to the other give the logistic curve that turns margins into scores.

The fit takes a sample of at most ``FIT_ROWS`` labelled rows, chosen by a hash of their ids, in
one task; the model is one row of ``4 * COLUMNS`` bytes.  Scoring reads every text whole.

Defined cases: a null or empty text has no indicators and gets the score of the bias alone; a
null id is not held out and never used to learn; repeated rows are scored alike; labels that
are null or not 0/1 are skipped; without labels of both classes every score is the share of
label 1 (one half if there is none); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.wordhash import gram_hashes, hash_words, split_words

#: Most labelled rows that the fit reads.
FIT_ROWS = 10_000
COLUMN_BITS = 18
COLUMNS = 1 << COLUMN_BITS
FOLDS, HELD_FOLD = 5, 0
CUT = 0.3

WORD_GRAMS, SHAPE_GRAMS = (1, 2), (1, 2, 3)
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
#: Weight of the fitted model against its mean magnitude.
INTERPOLATION = 0.75
SEED = 7

_SAME = np.uint64(0xA0761D6478BD642F)
_FACTOR = np.uint64(0xE7037ED1A0B428DB)
_shapes: dict[bytes, int] = {}


def _shape(word: bytes) -> int:
    """A number for the case of the letters and the marks at the end."""
    text = word.decode("utf-8", "replace")
    letters = "".join(c for c in text if c.isalpha())
    case = 0 if not letters else 1 if letters.islower() else 2 if letters.isupper() and len(letters) > 1 else 3 if letters[1:].islower() or len(letters) == 1 else 4
    digits = any(c.isdigit() for c in text)
    marks = text[len(text.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) :][-3:]
    return int.from_bytes(f"{case}{int(digits)}{marks}".encode()[:7], "little")


def _word_shapes(words: list[bytes]) -> np.ndarray:
    out = []
    for w in words:
        shape = _shapes.get(w)
        if shape is None:
            if len(_shapes) > 300_000:
                _shapes.clear()
            shape = _shape(w)
            if len(w) <= 64:
                _shapes[w] = shape
        out.append(shape)
    return np.array(out, "u8")


def indicators(text: str | None) -> np.ndarray:
    """The sorted distinct columns of a text."""
    words = split_words(text)
    if not words:
        return np.empty(0, "u4")
    hashes = hash_words(words)
    shapes = _word_shapes(words)
    shapes[1:][hashes[1:] == hashes[:-1]] ^= _SAME
    shapes = (shapes ^ (shapes >> np.uint64(32))) * _FACTOR
    grams = [gram_hashes(hashes, n) ^ np.uint64(n) for n in WORD_GRAMS] + [gram_hashes(shapes, n) ^ np.uint64(16 + n) for n in SHAPE_GRAMS]
    return np.unique((np.concatenate(grams) * _FACTOR) >> np.uint64(64 - COLUMN_BITS)).astype("u4")


def held_out(doc_id: Column) -> Column:
    """Whether an id's fold is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, columns: np.ndarray) -> float:
        if not len(columns):
            return self.bias
        return float(self.weights[columns].sum(dtype="f8") / np.sqrt(len(columns))) + self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = []
    for label in (1, -1):
        held = [r for r, own in zip(rows, y, strict=True) if own == label]
        c = SMOOTHING + np.bincount(np.concatenate([np.empty(0, "u4"), *held]).astype("i8"), minlength=COLUMNS)
        counts.append(c / c.sum())
    return np.log(counts[0] / counts[1])


def fit_hinge(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights per indicator (ratios included) and bias, by dual coordinate descent."""
    ratios = log_count_ratios(rows, y)
    scale = [ratios[r] / np.sqrt(max(1, len(r))) for r in rows]
    norm = np.array([float(s @ s) + 1.0 for s in scale])
    share = np.array([(y == v).mean() for v in (1, -1)])
    most = np.where(y == 1, COST * 0.5 / share[0], COST * 0.5 / share[1])
    w, bias, alpha = np.zeros(COLUMNS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            r, s = rows[i], scale[i]
            slack = y[i] * (float(w[r] @ s) + bias) - 1
            new = min(max(alpha[i] - slack / norm[i], 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[r] += step * s
                bias += step
    drawn = INTERPOLATION * w + (1 - INTERPOLATION) * np.abs(w).mean()
    return (ratios * drawn).astype("f4"), float(bias)


def fit_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton's method on smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == -1).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    theta = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (target - p))
        theta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def fit_model(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    y = np.where(labels == 1, 1, -1)
    half = np.arange(len(y)) % 2
    if any(len(np.unique(y[half == h])) < 2 for h in (0, 1)):
        share = float((labels == 1).mean()) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(COLUMNS, "f4"), 0.0, 0.0, float(np.log(share / (1 - share))))
    margins = np.zeros(len(y))
    for h in (0, 1):
        part = [r for r, own in zip(rows, half, strict=True) if own == h]
        weights, bias = fit_hinge(part, y[half == h])
        model = Model(weights, bias, 1.0, 0.0)
        margins[half != h] = [model.margin(r) for r, own in zip(rows, half, strict=True) if own != h]
    weights, bias = fit_hinge(rows, y)
    return Model(weights, bias, *fit_curve(margins, y))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """The model of a bounded sample of labelled rows outside the held-out fold."""
    known = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("label")).where(
        F.col("_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("_id"))
    )
    order = F.xxhash64(F.lit(SEED), "_id")
    sample = known.orderBy(order, "_id", "label").limit(rows)
    # bounded by ``rows``, so it may be broadcast; one row of each label is enough where ids repeat
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [indicators(t).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("label"), pa.array(columns, pa.binary())], ["id", "label", "columns"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [
            (i, y, np.frombuffer(c, "<u4"))
            for batch in batches
            for i, y, c in zip(*(batch.column(k).to_pylist() for k in ("id", "label", "columns")), strict=True)
        ]
        got.sort(key=lambda r: (r[0], r[1], len(r[2])))
        # ids that follow each other alternate between the halves
        model = fit_model([c for _, _, c in got], np.array([y for _, y, _ in got], "i8"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.tobytes()], pa.binary()), *(pa.array([float(v)]) for v in (model.bias, model.slope, model.shift))],
            ["weights", "bias", "slope", "shift"],
        )

    bounded = found.select("_id", "label", "text").mapInArrow(extract, "id long, label int, columns binary").limit(rows).coalesce(1)
    fitted = bounded.mapInArrow(fit, "weights binary, bias double, slope double, shift double").first()
    if fitted is None:
        return fit_model([], np.empty(0, "i8"))
    return Model(np.frombuffer(fitted["weights"], "f4"), fitted["bias"], fitted["slope"], fitted["shift"])


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.tobytes(), model.bias, model.slope, model.shift))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, *rest = shared.value
        own = Model(np.frombuffer(weights, "f4"), *rest)
        for batch in batches:
            margins = np.array([own.margin(indicators(t)) for t in batch.column("text").to_pylist()])
            scores = own.score(margins)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= cut).astype("i4"))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    thin = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return thin.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
