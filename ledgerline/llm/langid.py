"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary linear classifier over
hashed byte n-grams learns to tell the languages with a 1 from those with a 0.
A text's margins are compared with each codeword by a loss that weighs a bit by
how well its classifier does on the language's own training texts; the codeword
with the least loss wins, and a text is ambiguous where the second is close.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from . import _grams as G
from ._shared import fold, keyed

PER_LANGUAGE = 800   # training documents of each language, at most
COST = 1.0
FOLDS, HELD = 4, 2
AMBIGUOUS = 0.05     # least lead (difference of scores) of a clear decision
_LETTER = re.compile(r"[^\W\d_]")   # letters, and numerals such as superscripts, fractions and circled digits


def has_letter(text: str) -> bool:
    """Whether a character of a Unicode letter category is in the text."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def codewords(n: int):
    """``n`` codewords of +1 and -1, as rows: all splits in two for up to 7, else dense random codes.

    For more, the set with the largest least distance of 64 drawn ones is taken;
    the draw is fixed by n.
    """
    import numpy as np
    if n < 2:
        return np.zeros((n, 0), dtype=int)
    if n <= 7:
        splits = range(1, 2 ** (n - 1))
        return np.array([[1 if i == 0 or not s >> (i - 1) & 1 else -1 for s in splits] for i in range(n)])
    draw, best = np.random.default_rng(n), None
    for _ in range(64):
        code = draw.choice([-1, 1], size=(n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, abs(code.sum(0)) < n]  # a bit that is the same for all tells nothing
        apart = (code.shape[1] - (code @ code.T - 2 * np.eye(n) * code.shape[1])).min()
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, cost: float = COST) -> dict:
    """The model for rows (doc_id, text, label = language); null languages are left out."""
    import numpy as np
    rows, labels, _ = G.sampled_indicators(labelled, labelled, per_language, True, False)
    names = sorted(set(labels))
    code, of = codewords(len(names)), np.array([names.index(x) for x in labels], dtype=int)
    weights, biases = np.zeros((G.SIZE, code.shape[1]), dtype=np.float32), np.zeros(code.shape[1])
    trust = np.ones(code.shape)
    for bit in range(code.shape[1]):
        y = code[of, bit]
        share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())  # either side counts the same
        w, b = G.hinge_descent(rows, y, cost * 0.5 / share, G.SIZE, epochs=10)
        weights[:, bit], biases[bit] = w, b
        margins = np.array([w[r].sum() / max(np.sqrt(len(r)), 1) + b for r in rows])
        trust[:, bit] = [(margins[of == i] * code[i, bit] > 0).mean() for i in range(len(names))]
    return {"names": names, "code": code, "weights": weights, "bias": biases,
            "trust": trust / np.maximum(trust.sum(1, keepdims=True), 1e-12) * code.shape[1]}


def _decoder(model: dict, ambiguous: float):
    """text -> (language, score, ambiguous), for use in a task."""
    import numpy as np
    names, code, weights, trust = model["names"], model["code"], model["weights"], model["trust"]

    def decode(text: str):
        if not names or not has_letter(text):
            return "und", 0.0, True
        seen = np.flatnonzero(G.indicators(text, True, False))
        margin = weights[seen].sum(0, dtype=np.float64) / np.sqrt(max(len(seen), 1)) + model["bias"]
        loss = (trust * np.log1p(np.exp(np.clip(-2 * code * margin, -30, 30)))).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return names[order[0]], float(p[order[0]]), bool(len(p) > 1 and p[order[0]] - p[order[1]] < ambiguous)

    return decode


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
             ambiguous: float = AMBIGUOUS) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and ambiguous for every whole text.

    ``und`` with score 0 for null and empty texts, texts without a letter, and
    where no language could be learnt. Repeated rows give a row each; null ids
    stay null; an empty table gives no rows. Only the text is looked at.
    """
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        decode = _decoder(model, ambiguous)
        for batch in batches:
            found = [decode(text.as_py()) for text in batch.column(1)]
            langs, scores, doubt = ([x[i] for x in found] for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(doubt, pa.bool_())],
                                             names=["doc_id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: dict, text_col: str = "text", ambiguous: float = AMBIGUOUS) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is clear: neither ``und`` nor ambiguous. Nothing is shuffled.

    Where no language could be learnt, nothing can be told from a text: all rows are passed on.
    """
    if not model["names"]:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        decode = _decoder(model, ambiguous)
        for batch in batches:
            yield batch.filter(pa.array([not decode(t.as_py() or "")[2] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col):
    return fold(id_col, FOLDS) == HELD


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> dict:
    """The model from the documents outside the held-out fold that carry a language."""
    known = keyed(docs, id_col, text_col, lang_col).withColumnRenamed(lang_col, "label")
    return train(known.filter(~held_out(F.col("doc_id"))), per_language)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learn from ``docs`` outside the held-out fold, then identify all: doc_id, held_out, lang_pred, score, ambiguous."""
    model = learn(docs, id_col, text_col, lang_col, per_language)
    return identify(docs, model, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
