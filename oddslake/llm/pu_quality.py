"""A quality classifier from trusted positives and unlabelled text.

A small network on text statistics minimises the non-negative unbiased risk: the risk on negatives is
the risk of unlabelled text taken as negative less that of positives taken as negative, weighted by
the class prior, and steps that would drive it below zero are turned round. Training uses bounded
samples; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake.functions.computed import computed
from oddslake.llm.common import whole_text
from oddslake.llm.quality_rules import text_statistics
from oddslake.session import stored

#: Bound of each of the two samples that the classifier is fitted on.
SAMPLE_ROWS = 20_000
#: Prior used where the labels to learn from hold no second class.
DEFAULT_PRIOR = 0.5
#: Characters counted one kind at a time.
MARKS = {"c_bar": "|", "c_bang": "!?", "c_mark": "#*$%&<>", "c_stop": ".,;:", "c_digit": "0123456789", "c_at": "@=/_\\{}[]()\"'"}
FEATURES = ["f_words", "f_word", "f_symbol", "f_upper", "f_line", "f_repeat", "f_short", *[f"f{m[1:]}" for m in MARKS]]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the transformed text statistics of every row; nothing but the text goes in."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = computed(rows, **{n: F.length(t) - F.length(F.translate(t, m, "")) for n, m in MARKS.items() for t in [whole_text("text")]})
    rows = text_statistics(rows, whole_text("text"))
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    root = lambda a, b: F.sqrt(a / b)
    return rows.select(
        "doc_id", F.log1p("n_words").alias("f_words"), F.log(chars / words).alias("f_word"), root(F.col("n_symbols"), chars).alias("f_symbol"),
        root(F.col("n_upper"), chars).alias("f_upper"), root(F.col("n_dup_lines"), lines).alias("f_line"), root(F.col("n_repeat_words"), words).alias("f_repeat"),
        F.log(words / lines).alias("f_short"), *[root(F.col(m), chars).alias(f"f{m[1:]}") for m in MARKS],
    )


@dataclass(frozen=True)
class Network:
    """One hidden layer; ``centre`` and ``scale`` are those of the training rows."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.centre) / self.scale, -8, 8) @ self.w1 + self.b1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w2 + self.b2


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 12, epochs: int = 60, batch: int = 512, rate: float = 0.01, seed: int = 5) -> Network:
    """Minimise the non-negative risk with the logistic loss by Adam on mini-batches."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    centre, scale = both.mean(0), np.maximum(both.std(0), 1e-3)
    d = both.shape[1]
    net = Network(centre, scale, rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0

    def gradient(x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Gradient of a risk whose derivative by each row's logit is ``slope``."""
        z = np.clip((x - centre) / scale, -8, 8)
        h = np.tanh(z @ values[0] + values[1])
        back = slope[:, None] * values[2] * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ slope, slope.sum(keepdims=True)]

    steps = max(1, len(unlabelled) // batch)
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for k in range(steps):
            u = unlabelled[u_order[k * batch : (k + 1) * batch]]
            p = positive[p_order[np.arange(k * batch, (k + 1) * batch) % len(positive)]]
            now = Network(centre, scale, *values[:3], float(values[3][0]))
            zp, zu = now.logits(p), now.logits(u)
            sp, su = _sigmoid(zp), _sigmoid(zu)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            as_negative = [a - b for a, b in zip(gradient(u, su / len(u)), gradient(p, prior * sp / len(p)), strict=True)]
            if negative >= 0:
                grads = [a + b for a, b in zip(gradient(p, prior * (sp - 1) / len(p)), as_negative, strict=True)]
            else:
                grads = [-g for g in as_negative]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                values[i] = values[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Network(centre, scale, *values[:3], float(values[3][0]))


def _sample(rows: DataFrame, bound: int, seed: int) -> np.ndarray:
    """Feature rows of a seeded sample of about ``bound`` rows, all if there are fewer."""
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    found = rows.orderBy("doc_id").select(*FEATURES).toPandas()
    return found.to_numpy(float)


def _scores(net: Network):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy() for n in FEATURES], 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(_sigmoid(net.logits(x)))], schema=schema)

    return run


def classify(docs: DataFrame, labels: DataFrame, learn: Column, prior: float | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row: doc_id, score (0 to 1).

    ``labels`` has doc_id and quality; ``learn``, a condition on doc_id, tells which rows may be learned
    from. The trusted positives are those with quality 1, the unlabelled text is all of it. The prior
    is the share of quality 1 among the labels to learn from unless given. Null text counts as empty;
    rows with null labels are unlabelled; repeated rows are scored alike; without a positive every
    score is the prior; an empty table gives no rows. Features are stored, a narrow row a document.
    """
    rows = stored(features(docs, id_col, text_col))
    trusted = labels.where(learn & F.col("quality").isNotNull()).select("doc_id", "quality")
    share = trusted.agg(F.avg((F.col("quality") == 1).cast("double")).alias("share")).first()["share"]
    if prior is None:
        prior = share if share is not None and 0 < share < 1 else DEFAULT_PRIOR
    known = trusted.where("quality = 1").select("doc_id").distinct()
    positive = _sample(rows.join(known, "doc_id", "left_semi"), sample_rows, 1)
    unlabelled = _sample(rows.where(learn), sample_rows, 2)
    if not len(positive) or not len(unlabelled):
        return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(float(prior)).alias("score"))
    return rows.mapInArrow(_scores(fit(positive, unlabelled, prior)), "doc_id BIGINT, score DOUBLE")
