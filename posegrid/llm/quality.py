"""A co-trained quality classifier: text content and page metadata as two views.

1. One pass over whole texts measures each document's content view: shares of kinds of characters,
   repeated words, lengths of words, lines and sentences. The metadata view has language, source and
   the stated length. Both are written as one small table.
2. Each view's classifier is fitted on a sample of at most ``max_rows`` labelled rows. For
   ``rounds`` rounds both score all documents without a label, in the sample or not; of those that a view
   is sure enough of, the surest ``exchange`` of each label become pseudo-labels of the other view, one
   for each distinct pair of views, so that copies count once. Pseudo-labels of earlier rounds
   stay. A view teaches only if the calibration fold shows that it ranks
   better than chance by ``skill``. ``Quality.exchanged`` tells how many each view passed on.
3. A fold of the labels that no fit has seen calibrates each view (Platt) and their combination. The
   weights of the combination are not negative: a view that would count against itself gets none, and
   the other is fitted again by itself.
4. Every document gets both calibrated scores and the combined one.

Defined results
  * null text is empty; null metadata is a value of its own; missing metadata columns are null;
  * labels that are null are no labels; of several labels of an id the smallest counts;
  * without labels of both kinds in the sample every score is 0.5, and nothing is rejected;
  * rows that repeat an id are scored one by one, and the one with the smallest views is learnt from;
  * a null id is scored like any other;
  * without documents the result is empty; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posegrid.llm._common import Scratch, bounded
from posegrid.llm._fit import logistic, sigmoid

MAX_ROWS = 20_000
ROUNDS = 3
EXCHANGE = 500
SURE = 0.95
SKILL = 0.55
BINS = 10
HASHED = 64

#: The measures of the content view, in order.
CONTENT = (
    "letters", "upper", "digits", "white", "symbols", "stops", "commas", "marks", "pipes", "high",
    "log_words", "distinct", "again", "word_length", "upper_words", "symbol_words", "line_words", "sentence_words", "top_word",
)

_KIND = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = (
        9 if _i >= 128 else 1 if "A" <= _c <= "Z" else 0 if "a" <= _c <= "z" else 2 if _c.isdigit() else 3 if _c.isspace()
        else 5 if _c == "." else 6 if _c in ",;:" else 7 if _c in "!?" else 8 if _c == "|" else 4
    )


def content(text: str | None) -> np.ndarray:
    """The content view of one text."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(data))
    k = np.bincount(_KIND[data], minlength=10)
    words = text.split()
    m = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    distinct = list(counts)
    upper = sum(counts[w] for w in distinct if len(w) > 1 and w.isupper())
    odd = sum(counts[w] for w in distinct if w[-1] in "$%&*#|!~^=_<>" or w == "|")
    return np.array([
        (k[0] + k[1] + k[9]) / n, k[1] / n, k[2] / n, k[3] / n, k[4] / n, k[5] / m, k[6] / m, k[7] / m, k[8] / m, k[9] / n,
        np.log1p(len(words)), len(counts) / m, again / m, len(text) / m, upper / m, odd / m,
        len(words) / (1 + text.count("\n")), len(words) / (1 + k[5]), max(counts.values(), default=0) / m,
    ])


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """The metadata view: the logarithm of the length, and the hashed language and source."""
    spot = lambda name, value: zlib.crc32(f"{name}={value}".encode()) % HASHED
    out = np.zeros(1 + 2 * HASHED)
    out[0] = -1 if n_chars is None else np.log1p(max(0, n_chars))
    out[1 + spot("lang", lang)] = 1
    out[1 + HASHED + spot("source", source)] = 1
    return out


def measured(docs: DataFrame, scratch: Scratch, kept: list[str] | None = None) -> DataFrame:
    """(doc_id, x, m): both views of every row; with ``kept`` also these columns of the row, as a struct ``row``."""
    have = set(docs.columns)
    of = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    row = [] if kept is None else [F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")]
    rows = docs.select("doc_id", of("text", "string"), of("lang", "string"), of("source", "string"), of("n_chars", "long"), *row)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, text, lang, source, n, *row = batch.columns
            x = [content(t.as_py()).astype(np.float32) for t in text]
            m = [metadata(*(v.as_py() for v in r)).astype(np.float32) for r in zip(lang, source, n, strict=True)]
            # most of the metadata view is zero: the places of its ones are kept
            short = [[float(r[0]), *map(float, np.flatnonzero(r[1:]))] for r in m]
            kind = pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays([ids, pa.array(x, kind), pa.array(short, kind), *row], names=names)

    fields = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("x array<float>, m array<float>").fields, *rows.schema.fields[5:]])
    names = fields.names
    return scratch.table(rows.mapInArrow(run, fields), "views")


def _wide(m: np.ndarray) -> np.ndarray:
    out = np.zeros((len(m), 1 + 2 * HASHED))
    out[:, 0] = m[:, 0]
    for k in range(1, m.shape[1]):
        out[np.arange(len(m)), 1 + m[:, k].astype(int)] = 1
    return out


class View:
    """An additive logistic model: real columns are cut into bins at quantiles, others taken as they are."""

    def __init__(self, x: np.ndarray, y: np.ndarray, real: int, ridge: float = 1.0):
        self.cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(real)]
        self.real = real
        self.w, self.b = logistic(self.spread(x), y, ridge=ridge)
        self.scale = (1.0, 0.0)

    def spread(self, x: np.ndarray) -> np.ndarray:
        # a column for each cut that a value exceeds: neighbouring bins share weight
        parts = [(x[:, i, None] > c).astype(np.float32) for i, c in enumerate(self.cuts)]
        return np.hstack([*parts, x[:, self.real :]]) if parts else x

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return a * (self.spread(x) @ self.w + self.b) + b

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt: a line through the logits; a falling one would mean that the view knows nothing."""
        w, b = logistic(self.logit(x)[:, None], y, ridge=1e-3)
        self.scale = (w[0] * self.scale[0], w[0] * self.scale[1] + b) if w[0] > 0 else (0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    _, inverse, counts = np.unique(score[order], return_inverse=True, return_counts=True)
    rank = np.empty(len(y))
    rank[order] = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    n = int(y.sum())
    return (rank[y > 0].sum() - n * (n + 1) / 2) / max(1, n * (len(y) - n))


class Quality:
    """Both views and how they are combined; ``None`` models say 0.5."""

    def __init__(self, text: View | None, meta: View | None, mix: tuple[float, float, float]):
        self.text, self.meta, self.mix = text, meta, mix
        self.exchanged: dict[str, int] = {}

    def score(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            return (np.full(len(x), 0.5),) * 3
        a, b = self.text.logit(x), self.meta.logit(m)
        return sigmoid(a), sigmoid(b), sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


def _scored(views: DataFrame, model: Quality) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            m = _wide(np.array(batch.column(2).to_pylist(), np.float64).reshape(batch.num_rows, -1))
            cols = [pa.array(s, pa.float64()) for s in model.score(x, m)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "text_score", "meta_score", "score"])

    kind = dict(views.dtypes)["doc_id"]
    return views.select("doc_id", "x", "m").mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, score double")


def train(views: DataFrame, labels: DataFrame, scratch: Scratch, max_rows: int = MAX_ROWS, rounds: int = ROUNDS, exchange: int = EXCHANGE) -> Quality:
    """``labels``: doc_id, quality. ``max_rows`` labelled rows and 4 * rounds * exchange others are collected at most."""
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(F.min(F.col("quality").cast("int")).alias("y"))
    order = F.xxhash64(F.col("labelled").cast("string"), F.lit("quality"))
    sample = F.broadcast(labels.orderBy(order, "labelled").limit(max_rows))
    # one row an id: an id that many rows share must not reach the driver with all of them
    of_id = views.join(sample, F.col("doc_id") == F.col("labelled")).groupBy("doc_id").agg(F.min(F.struct("x", "m", "y")).alias("r"))
    rows = of_id.select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    nobody = Quality(None, None, (0, 0, 0))
    if not rows:
        return nobody
    y = np.array([r["y"] > 0 for r in rows], float)
    x = np.array([r["x"] for r in rows], np.float64)
    m = _wide(np.array([r["m"] for r in rows], np.float64))
    kept = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 4 == 0 for r in rows])  # the calibration fold
    if min(y[~kept].sum(), (~kept).sum() - y[~kept].sum(), y[kept].sum(), kept.sum() - y[kept].sum()) < 1:
        return nobody
    # no labelled document, in the sample or not, may get a pseudo-label; written once for all rounds
    unlabelled = scratch.table(views.join(bounded(labels.select("labelled")), F.col("doc_id") == F.col("labelled"), "left_anti"), "unlabelled")
    more: dict[str, tuple[list, list]] = {"text": ([], []), "meta": ([], [])}

    def fitted() -> Quality:
        def one(base, name, real):
            extra, label = more[name]
            both = np.vstack([base[~kept], *([np.array(extra)] if extra else [])])
            view = View(both, np.append(y[~kept], label), real)
            view.calibrate(base[kept], y[kept])
            return view

        return Quality(one(x, "text", x.shape[1]), one(m, "meta", 1), (1, 0, 0))

    model = fitted()
    exchanged = {"text": 0, "meta": 0}
    for _ in range(rounds):
        skill = {"text": auc(model.text.logit(x[kept]), y[kept]), "meta": auc(model.meta.logit(m[kept]), y[kept])}
        teachers = [t for t in ("text", "meta") if skill[t] > SKILL]
        if not teachers:
            break
        mine = scratch.table(_exchangeable(unlabelled.select("x", "m"), model).dropDuplicates(["x", "m"]), "scores")
        for teacher in teachers:
            pupil = "meta" if teacher == "text" else "text"
            p = F.col(f"{teacher}_score")
            rows, given = [], []
            for label, sure, by in ((1, p >= SURE, p.desc()), (0, p <= 1 - SURE, p.asc())):
                for r in mine.where(sure).orderBy(by, F.xxhash64("x", "m"), "x", "m").limit(exchange).collect():
                    rows.append(r["x"] if pupil == "text" else _wide(np.array([r["m"]], np.float64))[0])
                    given.append(float(label))
            more[pupil] = _together(more[pupil], (rows, given))
            exchanged[teacher] = len(more[pupil][0])
        model = fitted()
    a, b = model.text.logit(x[kept]), model.meta.logit(m[kept])
    # how much each calibrated view adds to the other
    w, c = logistic(np.stack([a, b], 1), y[kept], ridge=1.0)
    if min(w) < 0:
        only = 0 if auc(a, y[kept]) >= auc(b, y[kept]) else 1
        v, c = logistic((a, b)[only][:, None], y[kept], ridge=1.0)
        w = np.zeros(2)
        w[only] = max(0.0, v[0])
    model.mix = (float(w[0]), float(w[1]), float(c))
    model.exchanged = exchanged
    return model


def _together(old: tuple[list, list], new: tuple[list, list]) -> tuple[list, list]:
    """Pseudo-labels of earlier rounds and of this one; what a row is taken for now counts."""
    found = {np.asarray(r, np.float32).tobytes(): (r, v) for rows, labels in (old, new) for r, v in zip(rows, labels, strict=True)}
    return [r for r, _ in found.values()], [v for _, v in found.values()]


def _exchangeable(rows: DataFrame, model: Quality) -> DataFrame:
    """Rows with both scores; only those that a view is sure of."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            m = _wide(np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1))
            a, b, _ = model.score(x, m)
            sure = pa.array((np.maximum(a, 1 - a) >= SURE) | (np.maximum(b, 1 - b) >= SURE))
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(a), pa.array(b)], names=["x", "m", "text_score", "meta_score"])
            yield out.filter(sure)

    return rows.select("x", "m").mapInArrow(run, "x array<float>, m array<float>, text_score double, meta_score double")


def assess(docs: DataFrame, labels: DataFrame, scratch: Scratch, threshold: float = 0.5, **options) -> DataFrame:
    """Per row: doc_id, text_score, meta_score, score, rejected (score below ``threshold``)."""
    views = measured(docs, scratch)
    return _scored(views, train(views, labels, scratch, **options)).withColumn("rejected", F.col("score") < threshold)


def keep_good(docs: DataFrame, labels: DataFrame, scratch: Scratch, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns as they are."""
    # each row is written once beside its views, so that no text is measured twice and rows that share an id are judged one by one
    views = measured(docs, scratch, docs.columns)
    model = train(views.select("doc_id", "x", "m"), labels, scratch, **options)

    @F.pandas_udf("double")
    def judged(x: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_list()).astype(np.float64), _wide(np.stack(m.to_list()).astype(np.float64)))[2])

    return views.where(judged("x", "m") >= threshold).select("row.*")
