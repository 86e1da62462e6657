"""Operator 11, the trie of conversations' common beginnings: nodes with members, children, leaves and the tokens that sharing saves.

Turns become digests, so texts don't move. Conversations with the same turns become one path with a
count, before anything is gathered. Paths are dealt out by a hash of their first turn's digest into
buckets of about BUCKET_NODES nodes, and applyInPandas builds a bucket's subtries with dictionaries as
pointers and sums them up in an iterative postorder. A subtrie of more than MOST_NODES nodes is taken
apart first: the turns that all its paths share become nodes by a grouped sum, and what follows is
dealt out by the next turn, again and again until every part is small. Sums of the parts' tops then go
up through these rounds.

The hash of the conversations that end at a node needs their ids in order. Ids are range-sorted and
written as blocks of text, so that what one task reads of a node with very many is a few blocks.

A conversation's digests are one row, as a document's text is one. Null conv_id: its turns belong to no
conversation and are left out. Null turn: first. Ties, turns of one number: by the digest of role and
text; repeated rows are turns of their own. Null role or text: empty. Long texts: only digest and length
go on. No rows: no nodes, not even the root. Further columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import met, partitions, written

#: Nodes of a bucket, on average; nodes of a subtrie beyond which it is taken apart.
BUCKET_NODES, MOST_NODES = 20_000, 50_000
#: Conversations of one hundred share the beginning of the first of them, up to so many turns.
HUNDRED, HEAD_TURNS = 100, 5
#: Characters of a block of ids.
BLOCK = 1 << 20
NODES = "g binary, pg binary, is_top boolean, level int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"


def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def turn_paths(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each as digest and code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.length(text).cast("long").alias("chars"))
    return conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(paths: DataFrame) -> DataFrame:
    """Each conversation with the first turns of its hundred's first one before its own further ones; paths: what turn_paths() gives."""
    paths = written(paths, "turns")
    heads = paths.filter(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD_TURNS).alias("head"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD_TURNS + 1)).cast("int")
    rows = paths.withColumn("n", n).withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED).join(heads, "base", "left")
    return rows.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("n")), F.expr("slice(turns, 1, 0)")), F.slice("turns", F.col("n") + 1, F.size("turns"))).alias("turns"))


def _id_blocks(batches: Iterator) -> Iterator:
    """Rows (key, id) in order as (key, first id, ids joined by commas)."""
    import pyarrow as pa

    key, first, ids, length = None, None, [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["key", "first_id", "ids"])

    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (k != key or length > BLOCK):
                yield block()
                ids, length = [], 0
            if not ids:
                key, first = k, i
            ids.append(str(i))
            length += len(ids[-1]) + 1
    if ids:
        yield block()


def _block_hashes(batches: Iterator) -> Iterator:
    """Blocks in order as (key, SHA-256 of all its ids)."""
    import pyarrow as pa

    key, state, keys, hashes = None, None, [], []
    for batch in batches:
        for k, text in zip(batch.column(0), batch.column(2), strict=True):
            k, text = k.as_py(), text.as_py().encode()
            if state is not None and k == key:
                state.update(b"," + text)
                continue
            if state is not None:
                keys.append(key)
                hashes.append(state.digest())
            key, state = k, hashlib.sha256(text)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.binary())], names=["key", "ends"])
            keys, hashes = [], []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.digest()], pa.binary())], names=["key", "ends"])


def id_hashes(rows: DataFrame) -> DataFrame:
    """key and ends: SHA-256 of the decimal conv_ids of each key, ascending, joined by commas."""
    n = partitions(rows.sparkSession)
    dealt = rows.select("key", "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    blocks = dealt.mapInArrow(_id_blocks, "key binary, first_id long, ids string")
    return blocks.repartition(n, "key").sortWithinPartitions("key", "first_id").mapInArrow(_block_hashes, "key binary, ends binary")


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one bucket's subtries. rows: paths, each with its subtrie's key g and the depth top of that's first node."""
    kids, parent, depth, chars, n, low, ends, tops = [], [], [], [], [], [], [], {}

    def node(above: int, at: int, size: int) -> int:
        for column, x in ((kids, {}), (parent, above), (depth, at), (chars, int(size)), (n, 0), (low, None), (ends, None)):
            column.append(x)
        return len(kids) - 1

    about = {}
    for g, pg, level, top, up, ds, cs, count, first, end in zip(*(rows[c] for c in ("g", "pg", "level", "top", "up", "ds", "cs", "n", "low", "ends")), strict=True):
        at = tops.get(g)
        if at is None:
            at = tops[g] = node(-1, top, cs[top - 1])
            about[at] = g, pg, level, up
        for k in range(top, len(ds) + 1):
            if k > top:
                d = ds[k - 1]
                below = kids[at].get(d)
                if below is None:
                    below = kids[at][d] = node(at, k, cs[k - 1])
                at = below
            n[at] += count
            low[at] = first if low[at] is None else min(low[at], first)
        ends[at] = end
    leaves, saved = [0] * len(kids), [(k - 1) * c for k, c in zip(n, chars, strict=True)]
    out = []
    for top, (g, pg, level, up) in about.items():
        waiting, order = [top], []
        while waiting:
            at = waiting.pop()
            order.append(at)
            waiting.extend(kids[at].values())
        for at in reversed(order):  # children before their parents
            leaves[at] = leaves[at] or 1
            above = parent[at]
            if above >= 0:
                leaves[above] += leaves[at]
                saved[above] += saved[at]
            out.append((g, pg, at == top, level, low[at], depth[at], low[above] if above >= 0 else up, n[at], len(kids[at]), leaves[at], saved[at], ends[at]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])


def prefix_trie(conversations: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """Operator 11's query: the trie of the rebuilt conversations."""
    return trie(rebuilt(turn_paths(conversations)), most_nodes)


def trie(paths: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """The nodes of the trie of paths (conv_id, turns), one row each."""
    parts = lambda name: F.transform("turns", lambda x: x[name])
    rows = paths.select("conv_id", parts("digest").alias("ds"), parts("chars").alias("cs"))
    rows = written(rows.withColumn("key", _digest(F.array_join(F.transform("ds", F.hex), ""))), "paths")
    same = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.first(F.struct("ds", "cs")).alias("p"))
    seqs = written(same.join(id_hashes(rows), "key").select("key", "n", "low", "p.ds", "p.cs", "ends"), "sequences")
    root = seqs.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.sum(F.size("ds")).alias("nodes"), F.max(F.when(F.size("ds") == 0, F.col("ends"))).alias("ends"))
    of_root = root.head()
    no_group = F.lit(b"")
    level = seqs.filter("size(ds) > 0").select("ds", "cs", "n", "low", "ends", F.col("ds")[0].alias("g"), no_group.alias("pg"), F.lit(1).alias("top"), F.lit(of_root["low"]).cast("long").alias("up"), F.lit(1).alias("level"))
    small, taken = [], []
    while True:
        nodes = F.size("ds") - F.col("top") + 1
        big = written(level.groupBy("g").agg(F.sum(nodes).alias("nodes")).filter(F.col("nodes") > most_nodes).select("g"), "big")
        if big.isEmpty():
            small.append(level)
            break
        small.append(met(level, big, "g", "left_anti").select(level.columns))
        whole = met(level, big, "g", "left_semi")
        # Of all paths, the first and the last in order share what all share.
        groups = whole.groupBy("g").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.min(F.struct("ds", "cs", "ends")).alias("p"), F.max("ds").alias("last"), *(F.first(c).alias(c) for c in ("pg", "top", "up", "level")))
        alike = F.zip_with("p.ds", "last", lambda x, y: x.eqNullSafe(y))
        groups = groups.withColumn("shared", F.coalesce(F.nullif(F.array_position(alike, F.lit(False)), F.lit(0)) - 1, F.size(alike)).cast("int"))
        groups = written(groups.select("g", "pg", "n", "low", "shared", "top", "up", "level", F.slice("p.cs", F.lit(1), F.col("shared")).alias("cs"), F.when(F.size("p.ds") == F.col("shared"), F.col("p.ends")).alias("ends")), "groups")
        taken.append(groups)
        further = met(whole, groups.select("g", F.col("shared"), F.col("low").alias("above")), "g").filter("size(ds) > shared")
        key = _digest(F.concat(F.hex("g"), F.hex(F.element_at("ds", F.col("shared") + 1))))
        level = written(further.select("ds", "cs", "n", "low", "ends", key.alias("g"), F.col("g").alias("pg"), (F.col("shared") + 1).alias("top"), F.col("above").alias("up"), (F.col("level") + 1).alias("level")), "level")
    buckets = max(1, -(-(of_root["nodes"] or 0) // BUCKET_NODES))
    dealt = reduce(DataFrame.unionByName, small).withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))
    built = written(dealt.groupBy("bucket").applyInPandas(_built, NODES), "nodes")
    found, tops = [built.drop("g", "pg", "is_top", "level")], built.filter("is_top").select("pg", "level", "n_leaves", "saved_tokens")
    summed = (F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    for groups in reversed(taken):
        k = groups.select("level").head()["level"]
        below = tops.filter(F.col("level") == k + 1).groupBy(F.col("pg").alias("g")).agg(*summed)
        chain = groups.join(below, "g", "left").withColumn("leaves", F.coalesce("leaves", F.lit(1))).withColumn("kids", F.coalesce("kids", F.lit(0)))
        # The shared turns from the last to the first, each with what those from it on save.
        each = chain.select("*", F.explode(F.sequence("top", "shared")).alias("depth"))
        own = (F.col("n") - 1) * F.aggregate(F.slice("cs", F.col("depth"), F.col("shared") - F.col("depth") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
        inner = F.col("depth") < F.col("shared")
        each = written(
            each.select(
                "pg", "level", (F.col("depth") == F.col("top")).alias("is_top"), F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > F.col("top"), F.col("low")).otherwise(F.col("up")).alias("parent_conv_id"),
                F.col("n").alias("n_convs"), F.when(inner, 1).otherwise(F.col("kids")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (own + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), F.when(~inner, F.col("ends")).alias("ends"),
            ),
            "chains",
        )
        found.append(each.drop("pg", "is_top", "level"))
        tops = tops.unionByName(each.filter("is_top").select(tops.columns))
    first = tops.filter("level = 1").agg(*summed)
    found.append(
        root.filter("n IS NOT NULL").crossJoin(first).select(  # one row by one row
            F.col("low").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), "ends",
        )
    )
    out = reduce(DataFrame.unionByName, found)
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce(F.lower(F.hex("ends")), F.lit(none)).alias("ends_sha256"))
