"""Packing token streams into near-equal windows by multiway differencing.

A document's ids (with an end id) are cut into full windows from its start and
a remainder in a few equal pieces. The pieces are dealt into batches of about
``batch_tokens``; within a batch the Karmarkar-Karp method partitions them over
k windows: every piece starts as a partial partition of its own, the two
partial partitions with the largest imbalance (fullest minus emptiest window)
are merged with their imbalances opposed, until one is left. k starts at the
least count that could hold the batch and rises while any window exceeds the
capacity.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ._shared import by_bytes, cut, keyed

CAPACITY = 2048
PIECE_TOKENS = 256         # a remainder is cut into equal pieces of at most this many ids
BATCH_TOKENS = 256 << 10   # ids of remainders packed together: about 128 windows
RUN_CHARS = 4 << 20

_ENCODERS: dict = {}


def _encoder(path: str):
    """ids of a text, as numpy uint32, for a byte-level vocabulary in ``path`` (.json).

    Where the rank file of the same name lies beside it (``.tiktoken``, the same
    ids), that library's encoder is used, which is several times as fast; the
    tests hold both against each other. Texts it can't handle go to the other.
    """
    import os

    import numpy as np
    if path in _ENCODERS:
        return _ENCODERS[path]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(path)

    def slow(text):
        return np.asarray(exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    encode, ranks = slow, os.path.splitext(path)[0] + ".tiktoken"
    if os.path.exists(ranks):
        import base64

        import public_tokenizers
        import tiktoken
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t.content: i for i, t in exact.get_added_tokens_decoder().items()}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)

        def encode(text):
            try:
                return fast.encode_to_numpy(text, allowed_special="all")
            except Exception:  # e.g. a run of white space beyond the pattern library's stack
                return slow(text)
    _ENCODERS[path] = encode
    return encode


def difference(sizes: list[int], k: int) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp over ``k`` windows: (window sums, item numbers per window), ascending by sum.

    A partial partition is kept as its non-empty windows in ascending order.
    Opposed, the fullest windows of one meet the emptiest of the other, so only
    where both have windows beyond k do two windows join.
    """
    import numpy as np
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    joined, ticket = [], len(sizes)
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            v, n = np.concatenate([a, b]), np.concatenate([an, bn])
        else:
            b, bn, lone = b[::-1], bn[::-1], k - len(a)
            v = np.concatenate([b[:lone], a[:over] + b[lone:], a[over:]])
            fresh = len(sizes) + len(joined) + np.arange(over)
            joined += zip(an[:over].tolist(), bn[lone:].tolist())
            n = np.concatenate([bn[:lone], fresh, an[over:]])
        order = np.argsort(v, kind="stable")
        v, n = v[order], n[order]
        heapq.heappush(heap, (int((v[0] if len(v) == k else 0) - v[-1]), ticket, v, n))
        ticket += 1
    if not heap:
        return [], []
    windows = []
    for root in heap[0][3].tolist():
        items, todo = [], [root]
        while todo:
            x = todo.pop()
            if x < len(sizes):
                items.append(x)
            else:
                todo += joined[x - len(sizes)]
        windows.append(sorted(items))
    return heap[0][2].tolist(), windows


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their count rises until all fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sums, items = difference(sizes, k)
        if not sums or sums[-1] <= capacity:
            return items
        k += 1


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, piece_tokens: int, id_col: str,
           text_col: str, keep_ids: bool) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) per piece; a doc's pieces cover its ids in order."""
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        encode = _encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in by_bytes(texts, RUN_CHARS):
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i in range(lo, hi):
                    x = np.append(encode(texts[i]), np.uint32(end_id)).astype("<u4")
                    full, rest = divmod(len(x), capacity)
                    n = -(-rest // piece_tokens)
                    cuts = [j * capacity for j in range(full + 1)] + [full * capacity + rest * j // n for j in range(1, n + 1)]
                    for a, b in zip(cuts, cuts[1:]):
                        row.append(i)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(x[a:b].tobytes()))
                        total.append(len(x))
                        if keep_ids:
                            ids.append(x[a:b].astype(np.int32))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                out = [batch.column(0).take(pa.array(row, pa.int64()))] + [pa.array(c, pa.int64()) for c in (start, length, crc, total)]
                if keep_ids:
                    names, out = names + ["ids"], out + [pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
                           + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, piece_tokens: int = PIECE_TOKENS,
         batch_tokens: int = BATCH_TOKENS, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A sequence holds at most ``capacity`` ids. Full windows are sequences of
    their own; the other pieces are packed in batches dealt by a hash of the
    stored row number, so neither a hot source nor a repeated row makes a batch
    large: a batch holds about ``batch_tokens`` whatever the size of the input.
    Only the description of a piece (and, with ``keep_ids``, its ids) moves.

    Null and empty texts give one piece with the end id alone; repeated rows are
    documents of their own; null ids stay null; an empty table gives no rows;
    other columns are not read.
    """
    import pandas as pd
    cutup = pieces(docs, vocabulary, end_id, capacity, piece_tokens, id_col, text_col, keep_ids)
    cutup = cut(cutup.withColumn("piece", F.monotonically_increasing_id()))
    whole = F.col("length") == capacity
    n = cutup.filter(~whole).agg(F.sum("length").alias("n")).first()["n"] or 0
    batches = -(-n // batch_tokens) or 1

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece", ignore_index=True)
        sequence, offset = [0] * len(group), [0] * len(group)
        sizes = group["length"].tolist()
        for number, items in enumerate(windows(sizes, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = number, at
                at += sizes[i]
        return pd.DataFrame({"piece": group["piece"], "window": sequence, "offset": offset})

    loose = cutup.filter(~whole).withColumn("batch", F.pmod(F.xxhash64("piece"), F.lit(batches)))
    placed = (loose.select("batch", "piece", "length").groupBy("batch")
              .applyInPandas(lambda key, g: one(g).assign(batch=key[0]), "piece bigint, window bigint, offset bigint, batch bigint"))
    # Even numbers: packed windows, by batch; odd numbers: full windows, by piece.
    placed = placed.select("piece", (F.shiftleft("batch", 24) + F.col("window")).alias("window"), "offset")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    full = cutup.filter(whole).withColumns({"sequence_id": F.col("piece") * 2 + 1, "offset": F.lit(0).cast("bigint")})
    rest = cutup.filter(~whole).join(placed, "piece").withColumn("sequence_id", F.col("window") * 2)
    return full.select(columns).unionByName(rest.select(columns))
