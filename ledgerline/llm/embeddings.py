"""Near-duplicate vectors by random-hyperplane sign hashing.

Every vector gets a code, the signs of ``CODE`` random hyperplanes; each of
several tables keys it by some of these signs. Only ids and codes go to the
tables' buckets, where codes that differ in too many signs are passed over.
Vectors themselves are fetched for those left, compared by exact cosine, and
links give connected components. The number of signs a key follows the
logarithm of the number of vectors, the number of tables follows from it and
the miss rate allowed for a pair right at the threshold, and is bounded: beyond
that buckets grow instead, and large ones are compared block by block.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ._graph import components
from ._shared import cut

THRESHOLD = 0.9
MISS = 1e-3          # chance to miss a pair with a cosine right at the threshold
CODE = 256           # signs a vector, kept as four longs
FIRST = 128          # of them, whose differences are counted before a vector is fetched
WORDS = [f"c{i}" for i in range(CODE // 64)]
CODES = ", ".join(f"{c} bigint" for c in WORDS)
BUCKET = 1024        # unrelated vectors that share a bucket, about; their codes are compared, not they
MOST_TABLES = 192    # reached at about 130 million vectors
BLOCK = 8192         # a larger bucket is compared block by block, each pair of blocks on its own
GROUP_ROWS = 32768   # rows of buckets worked on together
GROUP_BYTES = 8 << 20  # of vectors worked on together, about
STRIP = 1 << 21      # pairs looked at together


def _differing(threshold: float, signs: int) -> list[float]:
    """Chance that a pair right at the threshold differs in 0, 1, ... of so many signs."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return [math.comb(signs, d) * p ** d * (1 - p) ** (signs - d) for d in range(signs + 1)]


def most_differing(threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Differences in the ``FIRST`` signs up to which two vectors are compared; a tenth of ``miss`` lies beyond."""
    chances, rest = _differing(threshold, FIRST), 1.0
    for d, x in enumerate(chances):
        rest -= x
        if rest <= miss / 10:
            return d
    return FIRST


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS, bucket: int = BUCKET) -> tuple[int, int]:
    """(signs a key, tables) for n vectors."""
    chances = _differing(threshold, CODE)
    for bits in range(min(24, max(2, math.ceil(math.log2(max(n, 2) / bucket)))), 0, -1):
        meet = [math.comb(CODE - d, bits) / math.comb(CODE, bits) for d in range(CODE + 1)]
        for tables in range(1, MOST_TABLES + 1):
            if sum(c * (1 - m) ** tables for c, m in zip(chances, meet)) <= miss * 0.9:
                return bits, tables
    return 0, 1  # one bucket


@functools.lru_cache(maxsize=8)
def planes(dim: int, seed: int = 11):
    import numpy as np
    return np.random.default_rng([seed, dim]).standard_normal((CODE, dim))


def places(bits: int, tables: int, seed: int = 13):
    """Which signs each table's key has: dealt from shuffled decks, so that all are used about equally often."""
    import numpy as np
    draw = np.random.default_rng([seed, bits])
    a_deck = CODE // max(bits, 1)
    decks = [draw.permutation(CODE)[:a_deck * bits].reshape(a_deck, bits) for _ in range(-(-tables // a_deck))]
    return np.sort(np.concatenate(decks)[:tables], axis=1)


def _units(m):
    """Rows in double precision and unit length."""
    import numpy as np
    m = m.astype(np.float64)
    m /= np.abs(m).max(1, keepdims=True)  # neither overflow nor underflow in the square
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _unit(vector):
    """One vector as ``_units`` makes it; None where it can't link with anything."""
    import numpy as np
    if vector is None or any(x is None for x in vector):
        return None
    v = np.asarray(vector, dtype=np.float64)
    return _units(v[None])[0] if len(v) and np.isfinite(v).all() and v.any() else None


def _matrices(column):
    """(rows, matrix) for each length of the vectors in an Arrow list column; those that link with nothing are left out."""
    import numpy as np
    at, flat = column.offsets.to_numpy().astype(np.int64), column.values
    values = flat.fill_null(0).to_numpy(zero_copy_only=False)
    values = values if values.dtype == np.float32 else values.astype(np.float64)
    bad = ~np.isfinite(values) | flat.is_null().to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(bad)])
    size = np.diff(at)
    fine = ~column.is_null().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
    for dim in np.unique(size[fine & (size > 0)]):
        rows = np.flatnonzero(fine & (size == dim))
        m = values[at[rows][:, None] + np.arange(dim)] + values.dtype.type(0)  # no negative zeros
        some = m.any(1)
        yield rows[some], m[some]


def _named(m) -> list[bytes]:
    """A name for each row: 128 bits of SHA-256 over its numbers."""
    import hashlib
    return [hashlib.sha256(row.tobytes()).digest()[:16] for row in m]


def coded(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, dim, c0 to c3) of rows (vec_id, v): name and code of each vector, null where it links with nothing."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            n = batch.num_rows
            key, dims, codes = [None] * n, np.zeros(n, np.int32), np.zeros((n, len(WORDS)), np.int64)
            for rows, m in _matrices(batch.column(1)):
                signs = _units(m) @ planes(m.shape[1]).T >= 0
                codes[rows] = np.packbits(signs, axis=1, bitorder="little").view("<i8")
                dims[rows] = m.shape[1]
                for row, name in zip(rows, _named(m)):
                    key[row] = name
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(dims), *map(pa.array, codes.T.copy())],
                                             names=["vec_id", "key", "dim", *WORDS])

    return vectors.mapInArrow(run, f"vec_id {kind}, key binary, dim int, {CODES}")


def stored(vectors: DataFrame) -> DataFrame:
    """(key, v) of rows (vec_id, v): the numbers of each vector that can link, as bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            for _, m in _matrices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_named(m), pa.binary()), pa.array([row.tobytes() for row in m], pa.binary())], names=["key", "v"])

    return vectors.select("v").mapInArrow(run, "key binary, v binary")


def bucketed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """One row per class and table: cls, dim, c0 to c3, t, sig."""
    where = places(bits, tables)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            signs = np.unpackbits(_codes(batch).view(np.uint8), axis=1, bitorder="little")
            for t in range(tables):
                sig = (signs[:, where[t]].astype(np.int32) << np.arange(bits, dtype=np.int32)).sum(1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cls", "dim", *WORDS)), pa.array(np.full(len(sig), t, np.int32)), pa.array(sig)],
                                                 names=["cls", "dim", *WORDS, "t", "sig"])

    return classes.select("cls", "dim", *WORDS).mapInArrow(run, f"cls bigint, dim int, {CODES}, t int, sig int")


def _codes(table):
    import numpy as np
    return np.stack([np.asarray(table.column(c)).astype(np.int64) for c in WORDS], axis=1)


def _masks(bits: int, tables: int):
    """Each table's signs as a mask over the code."""
    import numpy as np
    on = np.zeros((tables, CODE), dtype=np.uint8)
    np.put_along_axis(on, places(bits, tables), 1, axis=1)
    return np.packbits(on, axis=1, bitorder="little").view("<u8")


def _buckets(table):
    """(order of the rows, their keys in that order, first row of each bucket and the end)."""
    import numpy as np
    keys = np.stack([np.asarray(table.column(k)).astype(np.int64) for k in ("dim", "t", "sig", "i", "j")], axis=1)
    order = np.lexsort(keys.T[::-1])
    keys = keys[order]
    return order, keys, np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]]))


def _strips(side, lone: bool):
    """(left rows, right rows) of a bucket, in strips of a bounded number of pairs; ``lone``: a block with itself."""
    import numpy as np
    left, right = (np.arange(len(side)),) * 2 if lone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    step = max(1, STRIP // max(1, len(right)))
    for s in range(0, len(left) if len(right) else 0, step):
        yield left[s:s + step], right[s + 1:] if lone else right


def _met_first(codes, p, q, masks, t: int):
    """Which of the pairs meet in table ``t`` first, as positions."""
    import numpy as np
    fresh = np.arange(len(p))
    apart = codes[p] ^ codes[q]
    for mask in masks[:t]:
        if not len(fresh):
            break
        fresh = fresh[(apart[fresh] & mask).any(1)]
    return fresh


def _candidates(table, bits: int, tables: int, most: int):
    """The rows of buckets that have a partner whose code is near and that they meet in no earlier table."""
    import numpy as np
    order, keys, starts = _buckets(table)
    codes, side = _codes(table)[order].view(np.uint64), np.asarray(table.column("side"))[order]
    masks, found = _masks(bits, tables), np.zeros(len(order), dtype=bool)
    for a, b in zip(starts, starts[1:]):
        lone, c = keys[a, 3] == keys[a, 4], codes[a:b]
        for left, right in _strips(side[a:b], lone):
            apart = sum(np.bitwise_count(c[left, None, w] ^ c[None, right, w]) for w in range(FIRST // 64))
            p, q = np.nonzero(apart <= most)
            p, q = left[p], right[q]
            if lone:
                p, q = p[p < q], q[p < q]
            fresh = _met_first(c, p, q, masks, int(keys[a, 1]))
            found[a + p[fresh]] = found[a + q[fresh]] = True
    return table.take(order[found]).select(["cls", "dim", *WORDS, "t", "sig", "i", "j", "side"])


def _links(table, bits: int, tables: int, threshold: float):
    """Links inside one group of buckets: per class the vectors linked with it, and an edge to the bucket's tree."""
    import numpy as np
    import pyarrow as pa
    order, keys, starts = _buckets(table)
    codes = _codes(table)[order].view(np.uint64)
    cls, m, side = (np.asarray(table.column(k))[order] for k in ("cls", "m", "side"))
    raw, masks = table.column("v").to_pylist(), _masks(bits, tables)
    out = {"cls": [], "add": [], "root": []}
    for a, b in zip(starts, starts[1:]):
        dim, t, lone, c = int(keys[a, 0]), int(keys[a, 1]), keys[a, 3] == keys[a, 4], codes[a:b]
        kind = np.float32 if len(raw[order[a]]) == 4 * dim else np.float64
        x = _units(np.frombuffer(b"".join(raw[o] for o in order[a:b]), dtype=kind).reshape(b - a, dim))
        add, root, used = np.zeros(b - a), np.arange(b - a), np.zeros(b - a, dtype=bool)
        for left, right in _strips(side[a:b], lone):
            p, q = np.nonzero(x[left] @ x[right].T >= threshold)
            p, q = left[p], right[q]
            if lone:
                p, q = p[p < q], q[p < q]
            # Counted by the first table in which the two meet.
            fresh = _met_first(c, p, q, masks, t)
            p, q = p[fresh], q[fresh]
            add += np.bincount(p, m[a:b][q], b - a) + np.bincount(q, m[a:b][p], b - a)
            used[p] = used[q] = True
            while len(p):  # smallest member reachable so far, by label passing between roots
                low, high = np.minimum(root[p], root[q]), np.maximum(root[p], root[q])
                p, q, low, high = (z[low < high] for z in (p, q, low, high))
                np.minimum.at(root, high, low)
                while (root[root] != root).any():
                    root = root[root]
        for i in np.flatnonzero(used):
            out["cls"].append(int(cls[a + i]))
            out["add"].append(int(add[i]))
            out["root"].append(int(cls[a + root[i]]))
    return pa.table(out, schema=pa.schema([("cls", pa.int64()), ("add", pa.int64()), ("root", pa.int64())]))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                 miss: float = MISS) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id, kept.

    Equal vectors are one class with a multiplicity before anything is compared,
    so a vector that fills a third of the table is compared once. A bucket of
    more than ``BLOCK`` classes is dealt into blocks and each pair of blocks is
    compared on its own, so no bucket lands in one task; nothing is capped. A
    task emits at most one row per class and bucket, never all pairs. Equality
    is told by 128 bits of SHA-256.

    Vectors that are null, zero, empty, or hold null or non-finite components
    link with nothing (component: themselves). Vectors of different lengths
    don't link. Repeated rows link with each other like other copies; a row
    with a null id links and counts, and its component is named by an id that
    isn't null, if there is one. Other columns are not read; an empty table
    gives no rows.
    """
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].alias("v"))
    named = cut(coded(rows))
    classes = named.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("m"), F.min(F.struct("dim", *WORDS)).alias("x"))
    classes = cut(classes.select("key", "first", "m", "x.*", F.monotonically_increasing_id().alias("cls")))
    n = classes.count()
    bits, tables = plan(n, threshold, miss)
    most, key = most_differing(threshold, miss), ["dim", "t", "sig"]
    sizes = bucketed(classes, bits, tables).groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    # Hot buckets are few next to the rows; others have one block.
    hot = cut(sizes.filter(F.col("size") > BLOCK).select(*key, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    met = bucketed(classes, bits, tables).join(hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # Block b meets itself and every other block: (i, j) with i <= j, on side 0 as i and on side 1 as j.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"), F.when(x < F.col("own"), 1).otherwise(0).alias("side")))
    met = met.withColumn("p", F.explode(pairs)).select("cls", *WORDS, *key, "p.*")
    groups = lambda k: F.pmod(F.xxhash64(*key, "i", "j"), F.lit(max(1, k)))
    met = met.withColumn("grp", groups(math.ceil(n * tables / GROUP_ROWS)))
    members = cut(met.groupBy("grp").applyInArrow(lambda table: _candidates(table, bits, tables, most),
                                                  f"cls bigint, dim int, {CODES}, t int, sig int, i int, j int, side int"))
    size = members.agg(F.sum(F.col("dim") * F.lit(8))).first()[0] or 0
    # A vector's numbers are fetched by its name, once for all its copies.
    numbers = stored(rows).groupBy("key").agg(F.max("v").alias("v"))
    held = members.join(classes.select("cls", "key", "m"), "cls").join(numbers, "key").drop("key").withColumn("grp", groups(math.ceil(size / GROUP_BYTES)))
    found = cut(held.groupBy("grp").applyInArrow(lambda table: _links(table, bits, tables, threshold), "cls bigint, add bigint, root bigint"))
    counts = found.groupBy("cls").agg(F.sum("add").alias("add"))
    comp = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    whole = classes.select("cls", "key", "first", "m").join(comp.withColumnRenamed("node", "cls"), "cls", "left").join(counts, "cls", "left")
    whole = cut(whole.select("key", "first", "m", F.coalesce("component", "cls").alias("component"), F.coalesce("add", F.lit(0)).alias("add")))
    names = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    whole = cut(whole.join(names, "component").select("key", "m", "add", "component_id"))
    out = named.select("vec_id", "key").join(whole, "key", "left")
    links = F.col("key").isNotNull()
    return out.select("vec_id", F.when(links, F.col("m") - 1 + F.col("add")).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
                      F.when(links, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
