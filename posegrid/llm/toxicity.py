"""A counterfactual-regularised toxicity classifier.

Features are the presence of words and of word beginnings (4 to 7 letters, so that inflected forms
share weight), once and at least twice. Of those that toxic documents have, the ones that tell most are kept, and a
logistic model is fitted with a ridge and a counterfactual penalty: in each labelled sentence with
an identity term the term is swapped for every other term of its kind, and the squared change of
the model's logit is penalised; so are the differences of the terms by themselves. A group's mere
mention then cannot move the score, however its mentions are spread over the labels.

The fit uses a sample of at most ``max_rows`` labelled rows of each label, the first by a hash of
the id, and at most MAX_FEATURES features. Executors find features and swaps in the sampled texts; the
driver gets counts of candidate features, the chosen features of each sampled row, and the sums of
products of changes, a matrix of the features. All of the data is scored, whole texts, with nothing
but the text as input.

Defined results
  * null and empty texts have the score of a text without features;
  * labels that are null are no labels; an id that is labelled twice is toxic if one label says so;
  * without labels of both kinds every score is the share of toxic labels, or 0 without any;
  * rows that repeat an id are scored one by one, and the smallest text of a labelled id is learnt from;
  * without documents the result is empty;
  * of features that tell the same the first by name is chosen; a null id is never learnt from;
  * columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.llm._common import Scratch
from posegrid.llm._fit import logistic, sigmoid

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)
TWICE = "+"
MAX_ROWS = 4000
MAX_FEATURES = 512
LEAST_DOCS = 3
LEAST_GAIN = 7

#: Terms that name groups, by kind and language. A swap stays within a kind and a language.
IDENTITY_TERMS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["girl", "boy"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "refugees", "natives", "foreigners"],
    ["elderly", "young", "disabled", "blind", "deaf"],
    ["frauen", "männer"], ["muslime", "christen", "juden"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"],
]


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


def of_text(text: str | None) -> set[str]:
    seen: Counter[str] = Counter()
    for w, n in Counter(WORD.findall((text or "").lower())).items():
        for f in features(w):
            seen[f] += n
    return {*seen, *(f + TWICE for f, n in seen.items() if n > 1)}


def swaps(text: str, terms=IDENTITY_TERMS) -> list[tuple[set[str], set[str]]]:
    """For each sentence with an identity term: the features before and after each swap."""
    kinds = {t: kind for kind in terms for t in kind}
    out = []
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        words = WORD.findall(sentence)
        for at, w in enumerate(words):
            for other in kinds.get(w, ()):
                if other != w:
                    swapped = " ".join([*words[:at], other, *words[at + 1 :]])
                    out.append((of_text(sentence), of_text(swapped)))
    return out


def terms_alone(terms=IDENTITY_TERMS) -> list[tuple[set[str], set[str]]]:
    return [(set(features(a)), set(features(b))) for kind in terms for a in kind for b in kind if a < b]


def gain(n: float, other: float, toxic: int, clean: int) -> float:
    """The likelihood-ratio statistic of a feature that ``n`` toxic and ``other`` clean texts have; 0 below twice the odds."""
    p = toxic / (toxic + clean)
    share = n / (n + other)
    if share < 2 * p / (1 + p):
        return 0.0
    return 2 * (n * np.log(share / p) + (other * np.log((1 - share) / (1 - p)) if other else 0))


def select(counts: list[tuple[str, int, int]], toxic: int, clean: int, most: int = MAX_FEATURES, least_docs: int = LEAST_DOCS) -> list[str]:
    """The features that toxic texts have more often. ``counts``: (feature, toxic texts, clean texts)."""
    scored = [(-gain(n, other, toxic, clean), f) for f, n, other in counts if n >= least_docs]
    return [f for g, f in sorted(scored)[:most] if -g > LEAST_GAIN]


def changes(pairs, at: dict[str, int]) -> Counter:
    """Sums of the products of changes, by pairs of chosen features."""
    out: Counter[tuple[int, int]] = Counter()
    for before, after in pairs:
        moved = [(at[f], 1) for f in after - before if f in at] + [(at[f], -1) for f in before - after if f in at]
        for i, a in moved:
            for j, b in moved:
                out[i, j] += a * b
    return out


class Toxicity:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def solve(cls, chosen: list[str], rows: list[list[int]], labels: list[int], changed: Counter, share: float, ridge: float = 0.1, counterfactual: float = 20.0) -> "Toxicity":
        """``rows``: the places of each row's chosen features; ``share``: of toxic rows among all labelled ones, to which the sample is weighted."""
        y = np.array(labels, float)
        x = np.zeros((len(rows), len(chosen)), np.float32)
        for k, found in enumerate(rows):
            x[k, found] = 1
        penalty = np.zeros((len(chosen), len(chosen)))
        for (i, j), v in changed.items():
            penalty[i, j] += v
        weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
        # each change of the logit counts as much as ``counterfactual`` labelled rows
        w, b = logistic(x, y, weight, ridge, counterfactual * penalty)
        return cls(dict(zip(chosen, map(float, w), strict=True)), b)

    @classmethod
    def constant(cls, share: float) -> "Toxicity":
        return cls({}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], share: float, terms=IDENTITY_TERMS, **options) -> "Toxicity":
        """From texts at hand."""
        if len(set(labels)) < 2:
            return cls.constant(share)
        counts: dict[str, list[int]] = {}
        for t, v in zip(texts, labels, strict=True):
            for f in of_text(t):
                counts.setdefault(f, [0, 0])[0 if v else 1] += 1
        chosen = select([(f, *n) for f, n in counts.items()], sum(labels), len(labels) - sum(labels))
        at = {f: i for i, f in enumerate(chosen)}
        changed = changes([*terms_alone(terms), *(p for t in texts for p in swaps(t, terms))], at)
        return cls.solve(chosen, [sorted(at[f] for f in of_text(t) if f in at) for t in texts], labels, changed, share, **options)

    def scores(self, texts) -> np.ndarray:
        memo: dict[str, tuple[str, ...]] = {}
        weights, out = self.weights, np.full(len(texts), self.bias)
        known = {f.removesuffix(TWICE) for f in weights}
        for k, text in enumerate(texts):
            hit: dict[str, int] = {}
            for w, n in Counter(WORD.findall((text or "").lower())).items():
                found = memo.get(w)
                if found is None:
                    if len(memo) > 200_000:
                        memo.clear()
                    found = memo[w] = tuple(f for f in features(w) if f in known)
                for f in found:
                    hit[f] = hit.get(f, 0) + n
            out[k] += sum(weights.get(f, 0.0) + (weights.get(f + TWICE, 0.0) if hit[f] > 1 else 0.0) for f in sorted(hit))
        return sigmoid(out)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, terms=IDENTITY_TERMS, **options) -> Toxicity:
    """``labels``: doc_id, toxic. At most ``max_rows`` rows of each label are learnt from; no text leaves the executors."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row for each label
    if not counts:
        return Toxicity({}, -35.0)
    share = counts.get(1, 0) / sum(counts.values())
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    picked = [labels.where(F.col("y") == v).orderBy(order, "doc_id").limit(max_rows) for v in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "labelled"))  # 2 * max_rows rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(sample, texts["doc_id"] == F.col("labelled")).groupBy("labelled").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    found = Scratch(docs.sparkSession, "toxicity").table(found, "sample")  # one row an id
    rows = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(rows) < 2:
        return Toxicity.constant(share)

    def features_of(batches):
        import pyarrow as pa

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                mine = list(of_text(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.string()), pa.array([y] * len(mine), pa.int32())], names=["feature", "y"])

    each = found.select("text", "y").mapInArrow(features_of, "feature string, y int").groupBy("feature")
    each = each.agg(F.count_if(F.col("y") == 1).alias("n"), F.count_if(F.col("y") == 0).alias("other")).where(F.col("n") >= LEAST_DOCS)
    p = rows[1] / (rows[0] + rows[1])
    have = F.col("n") / (F.col("n") + F.col("other"))
    told = 2 * (F.col("n") * F.log(have / p) + F.when(F.col("other") > 0, F.col("other") * F.log((1 - have) / (1 - p))).otherwise(0.0))
    told = F.when(have < 2 * p / (1 + p), 0.0).otherwise(told)
    best = each.where(told > LEAST_GAIN / 2).orderBy(told.desc(), "feature").limit(2 * MAX_FEATURES)  # select ranks them again, as for texts at hand
    chosen = select([(r["feature"], r["n"], r["other"]) for r in best.collect()], rows[1], rows[0])
    at = {f: i for i, f in enumerate(chosen)}

    def learnt(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64()]
        names = ["y", "places", "i", "j", "v"]
        for batch in batches:
            moved: Counter = Counter()
            some = []
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = text.as_py()
                some.append((y, sorted(at[f] for f in of_text(text) if f in at), None, None, None))
                moved.update(changes(swaps(text, terms), at))  # adds, also what is negative
            some += [(None, None, i, j, v) for (i, j), v in moved.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)] if some else [pa.array([], k) for k in kinds], names=names)

    out = found.select("text", "y").mapInArrow(learnt, "y int, places array<int>, i int, j int, v long")
    out = out.groupBy("y", "places", "i", "j").agg(F.sum("v").alias("v"), F.count("*").alias("rows")).collect()  # 2 * max_rows + MAX_FEATURES ** 2 rows at most
    mine = sorted((r["y"], list(r["places"])) for r in out if r["places"] is not None for _ in range(r["rows"]))
    changed = Counter({(r["i"], r["j"]): r["v"] for r in out if r["i"] is not None})
    for k, v in changes(terms_alone(terms), at).items():
        changed[k] += v
    return Toxicity.solve(chosen, [r[1] for r in mine], [r[0] for r in mine], changed, share, **options)


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = model.scores([t.as_py() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
