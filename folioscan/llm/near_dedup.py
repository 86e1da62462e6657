"""Operator 3, near-duplicate documents by a signature-coordinate inverted join.

A document's set holds its distinct shingles of WIDTH words (A-Z in lower case; words are what
stands between ASCII white space; fewer words than WIDTH make one shingle). Documents with equal
sets form a class. For the classes:

1. The set gets a MinHash signature of K coordinates. Classes are posted under each
   (coordinate, value), and the length of each posting list is counted.
2. Two sets of Jaccard similarity >= 0.8 agree on at least T of the K coordinates (K = 48, T = 25:
   missed with a probability of 3e-6 at exactly 0.8, less above). Prefix filter: with each class's
   postings ordered from the shortest list on, such a pair meets among the first K - T + 1. Lists
   of one class are skipped, and so is all that lies behind the prefix: long lists of common values.
3. A list doesn't emit its pairs. It names a pivot, the class whose postings are the most common.
   Each class goes to the pivot that it collides with most often; if their signatures have T
   collisions, the link is confirmed on the full sets. Confirmed links make first components.
4. What shares a list with a pivot of another component is compared with all of that component and
   all others like it, in blocks of bounded size: first collisions of signatures are counted, then
   what has a pair with T of them is compared on the full sets. After this every pair that shares a
   list is in one component or was compared, so no link that the prefix found is lost, and a group
   of n near copies costs n links, not n * n.

What isn't linked in a family is compared: n members with p probes take n * p comparisons of
signatures, in blocks that many tasks share. p counts only classes that share a list with the
family's pivot and hang together with none of it.

Null or blank text: an empty set, linked with nothing. Null doc_id: linked with nothing, kept. Rows
that share a doc_id are judged by their own text each. Long texts: whole sets, those of a block one
portion at a time. Ties: the smallest id stands for a class or component, and of pivots that are
equally common or collide equally often the smaller id is taken. No rows: no rows. Only doc_id and
text are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, met, partitions, released, small_batches, text_of, written
from .components import components

if TYPE_CHECKING:
    import numpy as np

WIDTH, SIMILAR = 5, 80
K, T = 48, 25
#: Shingles, and signatures, on one side of a block of comparisons, and shingles of the classes that
#: meet a pivot: at least, at most, and times the root of their number in a family, so that a family's
#: work is dealt out to many tasks, and a row of a large one isn't sent too often.
BLOCK_SHINGLES, BLOCK_SIGNATURES, BLOCK_STAR = (40_000, 400_000, 8), (250, 4_000, 1), (20_000, 400_000, 8)
#: Up to so many signatures, 25 MB, are broadcast.
BROADCAST_SIGNATURES = 100_000
#: Smaller sets reach a similarity of SIMILAR % with equal sets only.
LEAST = -(-SIMILAR // (100 - SIMILAR))

SET = "doc_id long, n_shingles long, k1 long, k2 long"


def _mix(x: np.ndarray) -> np.ndarray:
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    import numpy as np
    import xxhash

    code: dict[bytes, int] = defaultdict(count().__next__)
    ids = [np.fromiter(map(code.__getitem__, w), np.int64, len(w)) for t in texts for w in [(t or "").encode("utf-8", "surrogatepass").lower().split()]]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in code], dtype=np.uint64)
    out = []
    for words in ids:
        h = hashes[words] if len(words) else np.zeros(0, np.uint64)
        n = len(h) - width + 1
        if len(h) and n <= 0:
            x = np.full(1, len(h), np.uint64)
            for w in h.reshape(-1, 1):
                x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + w)
            out.append(x)
            continue
        x = np.zeros(max(0, n), np.uint64)
        for k in range(width if len(h) else 0):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        out.append(np.unique(x))
    return out


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """A row of k coordinates for each set; sets mustn't be empty."""
    import numpy as np

    rng = np.random.default_rng(20)
    salts, factors = rng.integers(0, 1 << 63, k, dtype=np.uint64), rng.integers(0, 1 << 62, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(sets), k), np.int32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    for j in range(k):
        out[:, j] = np.minimum.reduceat(((flat ^ salts[j]) * factors[j]) >> np.uint64(33), starts)
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    import struct

    import xxhash

    return struct.unpack("<qq", xxhash.xxh3_128_digest(s.tobytes()))


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (the set's digest), sig: one row a document, in the shared folder."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .tokens import portions

        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for texts in portions(batch.column(1).to_pylist()):
                sets = shingle_sets(texts, width)
                keys = [_digest(s) for s in sets]
                large = [s for s in sets if len(s) >= LEAST]
                sig = iter(signatures(large, K).tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[at : at + len(sets)], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), pa.array([next(sig) if len(s) >= LEAST else None for s in sets], pa.list_(pa.int32()))],
                    names=["doc_id", "n_shingles", "k1", "k2", "sig"],
                )
                at += len(sets)

    small_batches(docs.sparkSession)
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(rows, f"{SET}, sig array<int>"), "signed")


def _linked(inter: int | np.ndarray, a: int, b: int | np.ndarray, similar: int) -> bool | np.ndarray:
    return 100 * inter >= similar * (a + b - inter)


def _prefixes(rows: DataFrame) -> DataFrame:
    """rep, n, kv, central: the postings in each class's prefix. rep: the class's smallest id; n: its set's size."""
    reps = rows.filter("sig IS NOT NULL AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    posted = reps.select("rep", "n", F.posexplode("sig").alias("k", "v")).select("rep", "n", (F.col("k").cast("long") * (1 << 32) + F.col("v")).alias("kv"))
    lists = posted.groupBy("kv").agg(F.count("*").alias("freq")).filter("freq > 1")
    own = Window.partitionBy("rep")
    return written(
        posted.join(lists, "kv")
        .withColumn("rn", F.row_number().over(own.orderBy("freq", "kv")))
        .withColumn("m", F.count("*").over(own))
        .withColumn("central", F.sum("freq").over(own))
        .filter(f"rn <= m - {T} + 1")
        .select("rep", "n", "kv", "central"),
        "prefix",
    )


def _collisions(prefix: DataFrame) -> DataFrame:
    """rep, n, pivot, hits: how many lists name the pivot to the class."""
    pivots = prefix.groupBy("kv").agg(F.count("*").alias("len"), F.max(F.struct("central", F.bitwise_not("rep"))).alias("top")).filter("len > 1")
    return written(prefix.join(pivots, "kv").select("rep", "n", F.bitwise_not("top.col2").alias("pivot")).groupBy("rep", "n", "pivot").agg(F.count("*").alias("hits")), "collisions")


def _signatures(rows: DataFrame, name: str) -> DataFrame:
    """A row for each id, under these names."""
    return rows.filter("sig IS NOT NULL AND doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias(name), F.col("sig").alias(f"{name}_sig"))


def _star_links(docs: DataFrame, rows: DataFrame, collisions: DataFrame, width: int, similar: int) -> DataFrame:
    """a, b: each class with the pivot that it collides with most, confirmed on the full sets."""
    best = collisions.filter("rep != pivot").groupBy("rep", "n").agg(F.max(F.struct("hits", F.bitwise_not("pivot"))).alias("best")).select("rep", "n", F.bitwise_not("best.col2").alias("pivot"))
    matches = F.size(F.filter(F.zip_with("rep_sig", "pivot_sig", lambda x, y: x == y), lambda x: x))
    named = written(best, "named")
    # A pivot may have very many classes. The signatures of all pivots are a table, so that this join
    # is a broadcast while they are few, and else one that Spark can split.
    pivots = written(_signatures(rows, "pivot").join(named.select("pivot").distinct(), "pivot"), "pivots")
    heads = F.broadcast(pivots) if pivots.count() <= BROADCAST_SIGNATURES else pivots
    best = written(named.join(_signatures(rows, "rep"), "rep").join(heads, "pivot").filter(matches >= T).select("rep", "n", "pivot"), "best")
    dropped(named)
    dropped(pivots)
    # Each pivot's text is sent once for each block of the classes that go to it.
    sums = best.groupBy("pivot").agg(F.sum("n").alias("all"))
    blocks = sums.select("pivot", F.ceil(F.col("all") / _block_size(BLOCK_STAR)).cast("int").alias("blocks"))
    members = best.join(blocks, "pivot").select("rep", "pivot", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), F.lit(1).alias("side"))
    heads = blocks.select(F.col("pivot").alias("rep"), "pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"))
    dealt = met(docs, members.unionByName(heads), "rep").repartition(partitions(docs.sparkSession), "pivot", "block")

    def confirmed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .tokens import portions

        head, of = np.zeros(0, np.uint64), None
        for batch in batches:
            columns, at, found = [c.to_pylist() for c in batch.columns], 0, []
            for texts in portions(columns[0]):
                for own in shingle_sets(texts, width):
                    pivot, side, rep = (c[at] for c in columns[1:])
                    at += 1
                    if side == 0:
                        head, of = own, pivot
                    elif of == pivot and len(head) and len(own):
                        place = np.minimum(np.searchsorted(head, own), len(head) - 1)
                        if _linked(int((head[place] == own).sum()), len(own), len(head), similar):
                            found.append((rep, pivot))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return written(dealt.sortWithinPartitions("pivot", "block", "side").select("text", "pivot", "side", "rep").mapInArrow(confirmed, "a long, b long"), "links")


def _families(collisions: DataFrame, label: DataFrame) -> DataFrame:
    """family, rep, n, own, probe: what is still to be compared. All of a family, the probes with every one."""
    own = label.withColumnRenamed("node", "rep").withColumnRenamed("label", "own")
    named = collisions.join(own, "rep", "left").join(label.withColumnRenamed("node", "pivot").withColumnRenamed("label", "family"), "pivot", "left")
    named = named.select("rep", "n", F.coalesce("own", "rep").alias("own"), F.coalesce("family", "pivot").alias("family"))
    halo = written(named.filter("own != family").distinct(), "halo")
    core = named.select("rep", "n", "own").distinct().withColumn("family", F.col("own")).join(halo.select("family").distinct(), "family")
    return written(core.select("family", "rep", "n", "own", F.lit(False).alias("probe")).unionByName(halo.select("family", "rep", "n", "own", F.lit(True).alias("probe"))), "families")


def _block_size(block: tuple[int, int, int]) -> Column:
    """For a family whose weights sum up to the column all."""
    least, most, times = block
    return F.least(F.lit(most), F.greatest(F.lit(least), times * F.sqrt("all")))


def _dealt(everyone: DataFrame, weight: Column, block: tuple[int, int, int], columns: list[str]) -> DataFrame:
    """family, i, j, side, columns: each member (side 1) in a block with each share of its family's probes (side 0)."""
    sums = everyone.groupBy("family").agg(F.sum(weight).alias("all"), F.sum(F.when(F.col("probe"), weight)).alias("some"))
    size = _block_size(block)
    sizes = sums.select("family", F.ceil(F.col("all") / size).cast("int").alias("parts"), F.ceil(F.col("some") / size).cast("int").alias("probes")).filter("probes > 0")
    # A family may be large, so its rows stay where they are while the sizes are few enough to be sent.
    dealt = met(everyone, sizes, "family").withColumn("h", F.xxhash64("rep"))
    one, all_of = F.sequence(F.lit(0), F.col("probes") - 1), F.sequence(F.lit(0), F.col("parts") - 1)
    as_member = dealt.withColumn("j", F.pmod("h", "parts").cast("int")).withColumn("i", F.explode(one)).withColumn("side", F.lit(1))
    as_probe = dealt.filter("probe").withColumn("i", F.pmod("h", "probes").cast("int")).withColumn("j", F.explode(all_of)).withColumn("side", F.lit(0))
    named = ["family", "i", "j", "side", *columns]
    return as_member.select(named).unionByName(as_probe.select(named))


def _colliding(rows: DataFrame, everyone: DataFrame) -> DataFrame:
    """Those of everyone that have T collisions of signatures with another component's class of their family, on which side."""

    def counted(block):  # noqa: ANN001, ANN202  a pyarrow.Table: one block
        import numpy as np
        import pyarrow as pa

        side, own, rep = (np.array(block.column(c).to_pylist(), np.int64) for c in ("side", "own", "rep"))
        sig = np.array(block.column("rep_sig").to_pylist(), np.int32).reshape(len(side), -1)
        probes, members = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        there, found = sig[members], np.zeros(len(side), bool)
        for k in probes.tolist():
            hit = ((there == sig[k]).sum(1) >= T) & (own[members] != own[k])
            if hit.any():
                found[k] = True
                found[members[hit]] = True
        chosen = np.flatnonzero(found)
        family = block.column("family")[0].as_py() if len(side) else 0
        return pa.table({"family": pa.array([family] * len(chosen), pa.int64()), "rep": pa.array(rep[chosen]), "probe": pa.array(side[chosen] == 0)})

    signed_rows = _dealt(everyone, F.lit(1), BLOCK_SIGNATURES, ["rep", "own"]).join(_signatures(rows, "rep"), "rep")
    # A small block takes long, so tasks are as many as the session asks for, whatever their bytes.
    dealt = signed_rows.repartition(partitions(rows.sparkSession), "family", "i", "j")
    pairs = dealt.groupBy("family", "i", "j").applyInArrow(counted, "family long, rep long, probe boolean")
    chosen = pairs.groupBy("family", "rep").agg(F.max("probe").alias("chosen"))
    return written(everyone.join(chosen, ["family", "rep"]).select("family", "rep", "n", "own", (F.col("probe") & F.col("chosen")).alias("probe")), "colliding")


def _family_links(docs: DataFrame, everyone: DataFrame, width: int, similar: int) -> DataFrame:
    columns = ["family", "i", "j", "side", "rep", "own"]

    def compared(block):  # noqa: ANN001, ANN202  a pyarrow.Table: one block
        import pyarrow as pa

        sets = shingle_sets(block.column("text").to_pylist(), width)
        rows = list(zip(block.column("side").to_pylist(), block.column("rep").to_pylist(), block.column("own").to_pylist(), sets, strict=True))
        found = _block_links([r[1:] for r in rows if r[0] == 0 and len(r[3])], [r[1:] for r in rows if r[0] == 1 and len(r[3])], similar)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    dealt = met(docs, _dealt(everyone, F.col("n"), BLOCK_SHINGLES, ["rep", "own"]), "rep").select(*columns, "text")
    return written(dealt.repartition(partitions(docs.sparkSession), "family", "i", "j").groupBy("family", "i", "j").applyInArrow(compared, "a long, b long"), "links")


def links(docs: DataFrame, rows: DataFrame, width: int, similar: int) -> DataFrame:
    """a, b: links between representatives of classes, enough to connect all that are linked."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_of().alias("text"))
    prefix = _prefixes(rows)
    released(spark)
    collisions = _collisions(prefix)
    dropped(prefix)
    released(spark)
    first = _star_links(texts, rows, collisions, width, similar)
    released(spark)
    everyone = _families(collisions, written(components(first, "a", "b"), "labels"))
    released(spark)
    everyone = _colliding(rows, everyone)
    released(spark)
    second = _family_links(texts, everyone, width, similar)
    released(spark)
    return first.unionByName(second)


def _block_links(probes: list[tuple], members: list[tuple], similar: int) -> list[tuple[int, int]]:
    """Links between probes and members (rep, own label, set), leaving out those between what already hangs together here."""
    import numpy as np

    if not probes or not members:
        return []
    sets = [s for _, _, s in members]
    size = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for rep, own, mine in probes:
        low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        n = high - low
        at = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
        shared = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(_linked(shared, len(mine), size, similar)).tolist():
            a, b = root(own), root(members[j][1])
            if a != b:
                parent[a] = b
                out.append((rep, members[j][0]))
    return out


def near_duplicates(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document; kept marks the smallest id of each component."""
    rows = signed(docs, width)
    label = components(links(docs, rows, width, similar), "a", "b")
    classes = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    found = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("label", "rep").alias("found"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return (
        rows.drop("sig")
        .join(found, ["k1", "k2"], "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, component).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
