"""Prefix trie of conversations: sorted shards, and a skeleton of the paths that split them.

A conversation is a path of turns, each the digest of its role and text. Paths
are range partitioned with their ids, so that a path which a third of all
conversations have is dealt over several shards, and sorted. A node's members
are neighbours in that order: a node that lies in more than one shard is a
common beginning of the paths on both sides of a split. These nodes are the
skeleton; their trie is broadcast (a split has one path, so its size follows
from the number of shards). Each shard walks its paths once and finishes all
other nodes; of skeleton nodes it gives partial sums, which are reduced by a
grouping and rolled up the skeleton.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ._shared import cut

BLOCK, HEADS = 20, 4       # conversations of a block share the beginning of its first one: crc32(id) % HEADS turns
DIGEST = 32                # characters of a turn in a path
CHUNK = 1 << 20            # characters of ids in a row
NONE = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def paths(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
          block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """(conv_id, path, words): every rebuilt conversation, its digests in one string and the words of each turn.

    Turns go by number, null first, equal numbers by digest; texts don't travel. A conversation of very many turns is one
    row of 36 bytes a turn. The beginning of a block comes from one row that at most ``block`` conversations join.
    """
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    t = turns.select(turns[id_col].cast("long").alias("conv_id"), F.struct(
        turns[turn_col].alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("words")).alias("x"))
    own = t.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("own"))
    own = cut(own.withColumn("own", F.transform("own", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words")))))
    firsts = own.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("first"))
    n = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    both = own.withColumn("n", n).withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(firsts, "base", "left")
    shared = F.coalesce(F.slice("first", F.lit(1), F.col("n")), F.array().cast("array<struct<digest:string,words:int>>"))
    rest = F.slice("own", F.col("n") + 1, F.greatest(F.size("own") - F.col("n"), F.lit(0)))
    both = both.select("conv_id", F.concat(shared, rest).alias("t"))
    return both.select("conv_id", F.array_join("t.digest", "").alias("path"), F.col("t.words").alias("words"))


def _split(path: str) -> list[str]:
    return [path[i:i + DIGEST] for i in range(0, len(path), DIGEST)]


def skeleton(edges: list[tuple[int, str, str]]) -> dict[tuple[int, str], int]:
    """Trie of what the last path of a shard and the first of the next have in common: (node, digest) -> node; the root is 0.

    ``edges``: (shard, first path, last path) of shards with rows, one each. Numbers rise from parents to children.
    """
    trie = {}
    for (_, _, last), (_, first, _) in zip(edges, edges[1:]):
        node = 0
        for a, b in zip(_split(last), _split(first)):
            if a != b:
                break
            node = trie.setdefault((node, a), len(trie) + 1)
    return trie


SCHEMA = ("kind int, no long, shard int, seq long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, words long, ends string")
FINISHED, PARTIAL, ENDS = 0, 1, 2   # kinds of rows; ``no``: skeleton number of the parent, of the node, of the node


class _Node:
    __slots__ = ("no", "depth", "words", "least", "convs", "children", "leaves", "saved", "sha", "ids", "held", "kids")

    def __init__(self, no, depth, words):
        self.no, self.depth, self.words = no, depth, words
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.sha, self.ids, self.held, self.kids = None, [], 0, []


class _Walk:
    """One shard: the nodes of the current path are open, and a node is closed when a path without it comes."""

    def __init__(self, trie):
        self.trie, self.shard, self.rows, self.seq = trie, None, [], 0
        self.open, self.path = [_Node(0, 0, 0)], []

    def put(self, kind, no, *rest):
        self.rows.append((kind, no, self.shard, self.seq, *rest))
        self.seq += 1

    def add(self, shard, conv, path, words):
        self.shard = shard
        path, same = _split(path), 0
        for a, b in zip(path, self.path):
            if a != b:
                break
            same += 1
        while len(self.open) > same + 1:
            self.close()
        for depth in range(same, len(path)):
            up = self.open[-1]
            no = self.trie.get((up.no, path[depth])) if up.no is not None else None
            self.open.append(_Node(no, depth + 1, int(words[depth])))
        self.path, node = path, self.open[-1]
        node.convs += 1
        node.least = conv if node.least is None else min(node.least, conv)
        if node.no is None:
            node.sha = node.sha or hashlib.sha256()
            node.sha.update(f"{',' if node.held else ''}{conv}".encode())
            node.held = 1
        else:
            node.ids.append(str(conv))
            node.held += len(node.ids[-1]) + 1
            if node.held > CHUNK:
                self.flush(node)

    def flush(self, node):
        if node.ids:
            self.put(ENDS, node.no, *[None] * 8, ",".join(node.ids))
        node.ids, node.held = [], 0

    def close(self):
        node = self.open.pop()
        up = self.open[-1] if self.open else None
        if up:
            up.convs += node.convs
            up.least = node.least if up.least is None else min(up.least, node.least)
        if node.no is not None:
            self.flush(node)
            self.put(PARTIAL, node.no, node.least, node.depth, None, node.convs, node.children, node.leaves, node.saved, node.words, None)
            return
        node.leaves = node.leaves or 1   # without children it is the only leaf
        node.saved += (node.convs - 1) * node.words
        up.children += 1
        up.leaves += node.leaves
        up.saved += node.saved
        for kid in node.kids:            # now that their parent's smallest member is known
            self.put(FINISHED, None, kid[0], kid[1], node.least, *kid[2:])
        row = (node.least, node.depth, node.convs, node.children, node.leaves, node.saved, node.words, node.sha.hexdigest() if node.sha else NONE)
        if up.no is None:
            up.kids.append(row)
        else:
            self.put(FINISHED, up.no, row[0], row[1], None, *row[2:])


def _shards(trie):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def given(rows):
        return pd.DataFrame(rows, columns=names).astype({c: "object" for c in names})

    def walk(batches):
        state = _Walk(trie.value)
        for batch in batches:
            for row in zip(batch["shard"], batch["conv_id"], batch["path"], batch["words"]):
                state.add(*row)
            for i in range(0, len(state.rows), 10_000):
                yield given(state.rows[i:i + 10_000])
            state.rows = []
        if state.shard is not None:
            while state.open:
                state.close()
            for i in range(0, len(state.rows), 10_000):
                yield given(state.rows[i:i + 10_000])
    return walk


def _digests(batches):
    """SHA-256 of each node's ids, from chunks in order; only the state of the current one is held."""
    no = sha = None
    for batch in batches:
        done = []
        for n, ids in zip(batch["no"], batch["ends"]):
            if n != no:
                done += [(no, sha.hexdigest())] if sha else []
                no, sha = n, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["no", "ends"])
    if sha:
        yield pd.DataFrame([(no, sha.hexdigest())], columns=["no", "ends"])


def prefix_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """One row per distinct beginning (node) of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; a null turn number comes first, and turns of one number go by the digest of role and
    text, repeated rows being turns of their own. Rows without a conversation id belong to no conversation and are left
    out. Empty texts are turns of no words. An empty table has no conversation and so not even a root: no rows. Columns
    that aren't named are ignored. Turns are equal by a digest of 128 bits. The ids that end in one node are hashed in one
    task, since SHA-256 can't be put together from parts; they come in rows of a megabyte and only its state is held.
    """
    spark = turns.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = paths(turns, id_col, turn_col, role_col, text_col, block, heads).repartitionByRange(shards, "path", "conv_id")
    placed = cut(order.sortWithinPartitions("path", "conv_id").withColumn("shard", F.spark_partition_id()))
    edges = sorted(map(tuple, placed.groupBy("shard").agg(F.min("path"), F.max("path")).collect()))   # one row a shard
    trie = skeleton(edges)
    known = spark.sparkContext.broadcast(trie)
    found = cut(placed.select("shard", "conv_id", "path", "words").mapInPandas(_shards(known), SCHEMA))

    parts = found.filter(F.col("kind") == PARTIAL).groupBy("no").agg(
        F.min("conv_id"), F.max("depth"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max("words")).collect()
    sums = {r[0]: list(r[1:]) for r in parts}          # as many rows as the skeleton has nodes
    parent = {no: up for (up, _), no in trie.items()}
    for no in sorted(sums, reverse=True):              # children before their parents
        least, depth, convs, children, leaves, saved, words = sums[no]
        sums[no][4] = leaves or 1
        sums[no][5] = saved + (convs - 1) * words
        if no:
            up = sums[parent[no]]
            up[3], up[4], up[5] = up[3] + 1, up[4] + sums[no][4], up[5] + sums[no][5]
    rows = [(no, *s[:2], sums[parent[no]][0] if no else None, *s[2:6]) for no, s in sums.items()]
    bones = spark.createDataFrame(rows, "no long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")

    chunks = found.filter(F.col("kind") == ENDS).select("no", "shard", "seq", "ends").repartition("no").sortWithinPartitions("no", "shard", "seq")
    digests = chunks.select("no", "ends").mapInPandas(_digests, "no long, ends string")
    top = bones.join(digests, "no", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NONE)))
    ups = F.broadcast(bones.select("no", F.col("conv_id").alias("up")))
    rest = found.filter(F.col("kind") == FINISHED).join(ups, "no", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")).withColumnRenamed("ends", "ends_sha256")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return top.select(columns).unionByName(rest.select(columns))
