"""Hashed n-gram indicators of a text, and linear classifiers over them (numpy).

A text's features are the set of its hashed byte n-grams (1 to 4 bytes, lower
case or as it is) and, if asked for, of its words' shapes (length, first and
last byte) and the lengths of runs of words that look the same. A set has at most 2**BITS members, so its bitmap is 8 KB whatever the length of
the text: a training sample of n texts takes n times that.
"""

from __future__ import annotations

BITS = 16
SIZE = 1 << BITS
SLICE = 1 << 20  # bytes of a long text worked on at a time
MOST_SAMPLED = 40_000  # documents of a training sample, all labels together
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def indicators(text: str, lower: bool, words: bool):
    """Boolean array of SIZE: which hashed n-grams (and word shapes, with ``words``) the text has."""
    import numpy as np
    seen = np.zeros(SIZE, dtype=bool)
    data = np.frombuffer((text.lower() if lower else text).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    shift = np.uint32(32 - BITS)
    for at in range(0, len(data), SLICE):
        x = data[at:at + SLICE + 3].astype(np.uint32)
        gram = x
        for n, factor in enumerate(_FACTORS):
            if n:
                gram = gram[:-1] * np.uint32(257) + x[n:]
            seen[(gram * np.uint32(factor) + np.uint32(n)) * np.uint32(0x2C1B3C6D) >> shift] = True
    if words and len(data):
        blank = data <= 32
        ends = np.flatnonzero(blank)
        total = np.concatenate([[0], np.cumsum(data, dtype=np.uint64)])
        a, b = np.concatenate([[0], ends + 1]), np.concatenate([ends, [len(data)]])
        a, b = a[b > a], b[b > a]
        if len(a):
            length, sums = (b - a).astype(np.uint64), total[b] - total[a]
            first, last = data[a].astype(np.uint64), data[b - 1].astype(np.uint64)
            same = (sums[1:] == sums[:-1]) & (length[1:] == length[:-1]) & (first[1:] == first[:-1]) & (last[1:] == last[:-1])
            kind = np.minimum(length, 15) << np.uint64(16) | first << np.uint64(8) | last
            seen[((kind * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS))] = True
            runs = np.diff(np.flatnonzero(np.concatenate([[True], ~same, [True]])))
            seen[(np.minimum(runs, 8).astype(np.uint64) + np.uint64(1000)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)] = True
    return seen


def hinge_descent(rows: list, y, cost, size: int, epochs: int = 20, seed: int = 7, scale=None):
    """Dual coordinate descent for the L1-loss linear SVM; rows are sorted feature numbers.

    Each row counts with unit norm, its features weighted by ``scale`` (ones if
    None); ``cost`` bounds each row's dual variable. Returns (weights, bias).
    """
    import numpy as np
    scale = np.ones(size) if scale is None else scale
    norms = [1 / max(np.sqrt((scale[r] ** 2).sum()), 1e-12) for r in rows]
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x = scale[rows[i]] * norms[i]
            g = y[i] * (w[rows[i]] @ x + bias) - 1
            new = min(max(alpha[i] - g / 2, 0.0), cost[i])  # the squared norm with the bias is 2
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * x
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic_fit(margin, target, weight, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of P(1) = 1 / (1 + exp(-(a * margin + b))), by damped Newton steps with a small ridge."""
    import numpy as np
    x = np.column_stack([margin, np.ones(len(margin))])
    at = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (weight * (p - target)) + 1e-3 * at
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        at -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return float(at[0]), float(at[1])


def sampled_indicators(marks, docs, per_class: int, lower: bool, words: bool):
    """A bounded training sample: lists of feature numbers and of labels.

    ``marks`` has doc_id and label, ``docs`` doc_id and text. Of each label, the
    ``per_class`` documents with the smallest hash of their id are taken (fewer
    where all labels together would be more than ``MOST_SAMPLED``); ids are
    chosen first, in one pass for all labels, and sent to the texts, which
    become bitmaps of SIZE bits on the executors, so the driver gets
    ``MOST_SAMPLED`` x SIZE / 8 bytes at most, and no text but the chosen ones
    moves. Of a repeated id the greatest text is taken.
    """
    import numpy as np
    from pyspark.sql import Window, functions as F

    from ._shared import cut

    ids = marks.select("doc_id", F.col("label").cast("string").alias("label")).dropna().distinct()
    ids = cut(ids.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    sizes = cut(ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    labels = sizes.count()
    if not labels:
        return [], [], {}
    if labels > MOST_SAMPLED:
        raise ValueError(f"{labels} labels are more than a sample of {MOST_SAMPLED} documents can hold")
    counts = {r["label"]: r["n"] for r in sizes.orderBy("label").collect()}
    per_class = min(per_class, MOST_SAMPLED // labels)
    # One row a label, MOST_SAMPLED at most: small enough to send everywhere, so no label's ids meet in one task.
    # A hash is uniform: twice the wanted share of a label (and some) holds its smallest, so few rows are ranked.
    rank = F.xxhash64(F.col("doc_id").cast("string"))
    share = F.lit(2.0 * per_class + 200) / F.col("n")
    drawn = ids.join(F.broadcast(sizes), "label").select("doc_id", "label", rank.alias("rank"), share.alias("share")).filter(F.col("rank") / F.lit(2.0 ** 64) + 0.5 <= F.col("share"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("rank", "doc_id"))
    few = cut(drawn.withColumn("place", place).filter(F.col("place") <= per_class).select("doc_id", "label"))  # MOST_SAMPLED ids at most
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))

    def bitmaps(batches):
        import pyarrow as pa
        for b in batches:
            maps = [np.packbits(indicators(t or "", lower, words)).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(maps, pa.binary())], names=["doc_id", "label", "bits"])

    rows = texts.mapInArrow(bitmaps, "doc_id string, label string, bits binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"]))
    found = [np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8))) for r in rows]
    return found, [r["label"] for r in rows], counts
