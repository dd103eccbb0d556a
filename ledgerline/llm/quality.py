"""Document quality by Naive Bayes support vectors.

Hashed n-gram indicators are scaled by the class log-count ratio (how much
likelier a feature is in good than in bad text), each document is brought to
unit norm, and a linear hinge-loss model is fitted by dual coordinate descent.
A logistic curve through margins that the fit hasn't seen turns a margin into
a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from . import _grams as G
from ._shared import fold, keyed

PER_CLASS = 2000   # training documents of each class, at most; the fit doesn't grow with the corpus
COST = 1.0
THRESHOLD = 0.3
FOLDS = 5


def train(marks: DataFrame, docs: DataFrame, per_class: int = PER_CLASS, cost: float = COST) -> dict:
    """The model for ``marks`` (doc_id, label 0 or 1) of ``docs`` (doc_id, text); other and null labels are left out.

    With one class or none to learn from, the score is a constant: the share of
    label 1, or 0.5.
    """
    import numpy as np
    rows, labels, counts = G.sampled_indicators(marks.filter(F.col("label").isin(0, 1)), docs, per_class, False, True)
    y = np.array([1 if x == "1" else -1 for x in labels])
    if len(set(labels)) < 2:
        return {"constant": (1.0 if labels[0] == "1" else 0.0) if labels else 0.5}

    def fit(at):
        good, bad = np.ones(G.SIZE), np.ones(G.SIZE)
        for i in at:
            (good if y[i] > 0 else bad)[rows[i]] += 1
        ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
        w, bias = G.hinge_descent([rows[i] for i in at], y[at], np.full(len(at), cost), G.SIZE, scale=ratio)
        return ratio, w * ratio, bias

    def margin(model, row):
        ratio, w, bias = model
        return float(w[row].sum() / max(np.sqrt((ratio[row] ** 2).sum()), 1e-12) + bias)

    # Margins of every fourth document from a model that hasn't seen it, weighted to the labelled shares.
    kept, out = np.flatnonzero(np.arange(len(y)) % 4 != 0), np.flatnonzero(np.arange(len(y)) % 4 == 0)
    if len(set(y[kept])) < 2 or len(set(y[out])) < 2:
        kept = out = np.arange(len(y))
    part = fit(kept)
    margins = np.array([margin(part, rows[i]) for i in out])
    drawn = {k: sum(y[out] == v) for k, v in (("0", -1), ("1", 1))}
    weight = np.array([counts["1" if y[i] > 0 else "0"] / drawn["1" if y[i] > 0 else "0"] for i in out])
    slope, at = G.logistic_fit(margins, (y[out] + 1) / 2, weight * len(out) / weight.sum())
    ratio, w, bias = fit(np.arange(len(y)))
    return {"square": (ratio ** 2).astype(np.float32), "weights": w.astype(np.float32), "bias": bias, "slope": slope, "at": at}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and predicted (1 from ``threshold`` on) for every whole text.

    Null and empty texts get the score of a text without features; repeated
    rows a row each; null ids stay null; an empty table gives no rows. Only the
    text goes into the score.
    """
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            out = []
            for text in batch.column(1):
                if "constant" in model:
                    out.append(model["constant"])
                    continue
                seen = G.indicators(text.as_py(), False, True)
                norm = max(float(np.sqrt(model["square"][seen].sum(dtype=np.float64))), 1e-12)
                m = float(model["weights"][seen].sum(dtype=np.float64)) / norm + model["bias"]
                out.append(float(1 / (1 + np.exp(-np.clip(model["slope"] * m + model["at"], -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col):
    return fold(id_col, FOLDS) == 0


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """Train on the labels outside the held-out fold and score all of ``docs``.

    Returns doc_id, held_out, score and predicted. A document with labels 0 and
    1 is learnt as both; labels without a document are left out.
    """
    marks = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("label")).filter(~held_out(F.col("doc_id")))
    model = train(marks, keyed(docs, id_col, text_col), per_class)
    return score(docs, model, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
