"""Token counts: lengths only, from Arrow batches.

The tokenizer of a ``.json`` vocabulary drops white space before it merges, so
a space is a safe place to split: the count of a text is the sum of the counts
of its space-separated words, whatever the length of the text. Words that
recur are counted once per worker and looked up after that; the rest of each
text is encoded together. Texts go to the encoder in runs of about equal bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ._shared import keyed, runs

RUN_BYTES = 4 << 20        # bytes of text handed to the encoder at a time
PIECE_CHARS = 1 << 16      # longer texts are split at spaces into pieces of about this size
CACHE_WORDS = 200_000      # words remembered per worker; when full it starts anew

_COUNTERS: dict = {}       # one per worker process and vocabulary


class _JsonCounter:
    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core already
        from tokenizers import Tokenizer
        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.words: dict[str, int] = {}
        # Words may be looked up on their own only if a space never becomes part of a token.
        self.splits = [len(e) for e in self._encode(["a b", "a", "b", " a", "a "])] == [2, 1, 1, 1, 1] \
            and len(self._encode([" \n "])[0]) == 0

    def _encode(self, texts: list[str]):
        return self.t.encode_batch_fast(texts, add_special_tokens=False)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(e) for e in self._encode(texts)]
        known, rests, owner, seen = [], [], [], Counter()
        for i, text in enumerate(texts):
            words = text.replace("\n", " ").split(" ")
            found = list(map(self.words.get, words))
            known.append(sum(filter(None, found)))
            rest = [w for w, n in zip(words, found) if n is None]
            seen.update(rest)
            joined, start = " ".join(rest), 0
            while start < len(joined):  # pieces that end at a space
                end = joined.find(" ", start + PIECE_CHARS) if len(joined) - start > PIECE_CHARS else -1
                end = len(joined) if end < 0 else end
                rests.append(joined[start:end])
                owner.append(i)
                start = end
        for i, e in zip(owner, self._encode(rests)):
            known[i] += len(e)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        again = [w for w, n in seen.items() if n > 1 and len(w) < 64]
        for w, e in zip(again, self._encode(again)):
            self.words[w] = len(e)
        return known


class _PieceCounter:
    def __init__(self, path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode(texts, num_threads=1)]


def _counter(path: str):
    if path not in _COUNTERS:
        _COUNTERS[path] = (_PieceCounter if path.endswith(".model") else _JsonCounter)(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``vocabulary`` is the path of a ``.json`` (tokenizers) or ``.model``
    (sentencepiece) file that every executor can open. No begin, end or other
    special tokens are added; special strings inside a text are handled as the
    library does by default; nothing is truncated.

    Null and empty texts have 0 bytes and 0 tokens; a null id stays null;
    repeated rows give a row each; an empty table gives no rows; other columns
    are not read. Nothing is shuffled: a row's result depends on that row only.
    """
    rows = keyed(docs, id_col, text_col)
    ids = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        counter = _counter(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            n = []
            for a, b in runs(sizes.to_pylist(), RUN_BYTES):
                n += counter.counts(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(run, f"doc_id {ids}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
