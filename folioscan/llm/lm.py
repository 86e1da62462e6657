"""Operator 4, language-model scores from a log-frequency Bloom filter.

Words are what stands between ASCII white space, A-Z in lower case; each text ends with an end
token. Documents whose crc32(id) mod 5 isn't 1 are learnt from; all are scored.

1. Each task cuts its documents into blocks of about BLOCK_TOKENS tokens, coded by the block's own
   distinct words, and writes them to the shared folder. Frequent words appear once a block from
   here on, so no word is hot.
2. The blocks' words are counted by hash bucket; each block gets its words' exact counts back.
   base_score needs nothing else.
3. Words and bigrams of the learnt documents are counted by hash bucket. A count c is quantised to
   the level q = 1 + floor(log2 c), and (n-gram, 1) ... (n-gram, q) are put into a Bloom filter. A
   bucket has a segment of the filter of its own, so segments are made in parallel. The filter has
   FILTER_BITS_EACH bits for each learnt token and each level of a word, whatever the corpus.
4. Up to MAX_FILTER_BITS the filter is broadcast. A larger one is never in one place: each block's
   distinct n-grams go to their buckets, are probed against the same segments there, and their levels
   come back to the block. Both ways probe the same bits, so scores are the same. An n-gram's level is
   found by probing levels 1, 2, ... until one misses; its count c' is the middle of that level's
   range, and no bigram's count exceeds its words'. All of the model's probabilities come from these
   probes: p(v) = (c'(v) + 1/2) / (N + (V + 1) / 2), and p(v | u) = (c'(u v) + MU p(v)) / (c'(u) + MU),
   the context of the first token being an end.

Buckets are as many as the data need, about BUCKET_GRAMS n-grams each and LEAST_BUCKETS at least, so
neither a task nor a score depends on the session's partitions. Null text: one end token. Null
doc_id: learnt from. Repeated rows are counted and scored each. A long text makes a block of its own,
as long as it is. Without rows, or with none to learn from, N and V are 0 and both scores are
log10(1) a token. Ties: none. Only doc_id and text are read, so further columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, partitions, released, remainder, small_batches, text_of, written

if TYPE_CHECKING:
    import numpy as np

BLOCK_TOKENS = 500_000
FILTER_BITS_EACH, MAX_FILTER_BITS, HASHES = 8, 1 << 29, 3
BUCKET_GRAMS, LEAST_BUCKETS = 1 << 21, 64
MU = 30.0
END = b"\n"  # never a word

BLOCKS = "block string, n_words long, n_pairs long, words binary, counts binary, doc_ids array<long>, held_out array<boolean>, lengths array<int>, ids binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _mix(x: np.ndarray) -> np.ndarray:
    """Well spread 64 bits of 64 bits."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: bytes) -> np.ndarray:
    """A hash of each of a block's words."""
    import numpy as np
    import xxhash
    import zstandard

    return np.array([xxhash.xxh3_64_intdigest(w) for w in zstandard.ZstdDecompressor().decompress(words).split(b" ")], dtype="<u8")


def _ids(ids: bytes) -> np.ndarray:
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _grams(hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """48-bit hashes: for each token the pair that it ends, the first token's context being an end; then the block's words."""
    import numpy as np

    h = hashes[ids]
    before = np.empty_like(h)
    before[1:] = h[:-1]
    first = np.cumsum(lengths) - lengths
    before[first] = h[-1] if len(h) else 0  # each text ends with the end token
    return np.concatenate([_mix(before * np.uint64(0x9E3779B97F4A7C15) + h), _mix(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F))]) >> np.uint64(16)


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, so sorted hashes fall into buckets in order."""
    import numpy as np

    return ((grams >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _runs(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) for each bucket that occurs."""
    import numpy as np

    cuts = np.flatnonzero(np.diff(sorted_buckets, prepend=-1, append=-1)).tolist()
    return [(int(sorted_buckets[x]), x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def blocks_of(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents as coded blocks, in a table of the shared folder."""

    def blocks(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        schema = pa.schema([("block", pa.string()), ("n_words", pa.int64()), ("n_pairs", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary())])
        squeeze = zstandard.ZstdCompressor(level=1).compress
        part, seq = TaskContext.get().partitionId(), 0

        def block() -> pa.RecordBatch:
            table = [w for w, _ in sorted(code.items(), key=lambda x: x[1])]
            ids, size = np.fromiter(coded, np.uint32, len(coded)), np.array(lengths, np.int64)
            learnt = np.repeat(~np.array(held, bool), size)
            counts = np.bincount(ids[learnt], minlength=len(table)).astype("<u4")
            pairs = int(learnt.sum())
            return pa.RecordBatch.from_pylist([{"block": f"{part}-{seq}", "n_words": len(table), "n_pairs": pairs, "words": squeeze(b" ".join(table)), "counts": squeeze(counts.tobytes()), "doc_ids": names, "held_out": held, "lengths": lengths, "ids": squeeze(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())}], schema=schema)

        code: dict[bytes, int] = defaultdict(count().__next__)
        names, held, lengths, coded = [], [], [], []
        for batch in batches:
            for name, out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules for both
                tokens.append(END)
                coded += map(code.__getitem__, tokens)
                names.append(name)
                held.append(out)
                lengths.append(len(tokens))
                if len(coded) >= block_tokens:
                    yield block()
                    seq, code = seq + 1, defaultdict(count().__next__)
                    names, held, lengths, coded = [], [], [], []
        if names:
            yield block()

    small_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    return written(docs.select(doc_id.alias("doc_id"), (remainder(doc_id) == 1).alias("held_out"), text_of().alias("text")).mapInArrow(blocks, BLOCKS), "blocks")


def word_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, counts (of the block's words in that bucket, in their order), n, v, levels of the bucket: exact corpus counts."""

    def packets(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpack, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for name, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bucket, table = _word_bucket(_hashes(words), buckets), np.array(unpack(words).split(b" "), dtype=object)
                counts, order = np.frombuffer(unpack(counts), "<u4"), np.argsort(bucket, kind="stable")
                rows = [(b, order[x:y]) for b, x, y in _runs(bucket[order])]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32()), "block": [name] * len(rows), "words": pa.array([squeeze(b" ".join(table[k].tolist())) for _, k in rows], pa.binary()), "counts": pa.array([counts[k].tobytes() for _, k in rows], pa.binary())})

    def merged(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpack, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        code: dict[bytes, int] = defaultdict(count().__next__)
        total, kept = np.zeros(1024, np.int64), []
        for batch in batches:
            for bucket, name, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.fromiter(map(code.__getitem__, unpack(words).split(b" ")), np.int64)
                if len(code) > len(total):
                    total = np.concatenate([total, np.zeros(max(len(code) - len(total), len(total)), np.int64)])
                total[ids] += np.frombuffer(counts, "<u4")  # a block has each word once
                kept.append((bucket, name, ids.astype(np.uint32)))
        n, v, levels = int(total.sum()), int((total > 0).sum()), int(np.frexp(total)[1].sum())
        for k, (bucket, name, ids) in enumerate(kept):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "block": [name], "counts": pa.array([squeeze(total[ids].astype("<i8").tobytes())], pa.binary()), "n": [0 if k else n], "v": [0 if k else v], "levels": [0 if k else levels]})

    sent = blocks.select("block", "words", "counts").mapInArrow(packets, "bucket int, block string, words binary, counts binary")
    return sent.repartition(buckets, "bucket").mapInArrow(merged, "bucket int, block string, counts binary, n long, v long, levels long")


def _word_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    import numpy as np

    return (hashes % np.uint64(buckets)).astype(np.int64)


def gram_packets(blocks: DataFrame, buckets: int, held_out: bool) -> DataFrame:
    """block, bucket, grams (distinct, sorted), times learnt: those of held-out documents too if held_out."""

    def packets(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpack, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for name, words, counts, held, lengths, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = np.array(lengths, np.int64)
                grams = _grams(_hashes(words), _ids(ids), size)
                times = np.concatenate([np.repeat(~np.array(held, bool), size), np.frombuffer(unpack(counts), "<u4")])
                if not held_out:
                    grams, times = grams[times > 0], times[times > 0]
                grams, place = np.unique(grams, return_inverse=True)
                times = np.bincount(place, weights=times, minlength=len(grams))
                rows = []
                for b, x, y in _runs(_bucket(grams, buckets)):
                    steps = np.diff(grams[x:y], prepend=np.uint64(0)).astype("<u8")
                    rows.append((b, squeeze(steps.view(np.uint8).reshape(-1, 8).T.tobytes()), squeeze(times[x:y].astype("<u4").tobytes())))
                yield pa.RecordBatch.from_pydict({"block": pa.array([name] * len(rows), pa.string()), "bucket": pa.array([r[0] for r in rows], pa.int32()), "grams": pa.array([r[1] for r in rows], pa.binary()), "times": pa.array([r[2] for r in rows], pa.binary())})

    return blocks.select("block", "words", "counts", "held_out", "lengths", "ids").mapInArrow(packets, "block string, bucket int, grams binary, times binary")


def _received(batches: Iterator) -> dict[int, list]:
    """For each bucket its packets: block, grams, times."""
    import numpy as np
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    out: dict[int, list] = defaultdict(list)
    for batch in batches:
        for name, bucket, steps, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            steps = np.frombuffer(unpack(steps), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
            out[bucket].append((name, np.cumsum(steps, dtype=np.uint64), np.frombuffer(unpack(times), "<u4")))
    return out


def _counted(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's n-grams, the level of each (0: not learnt), and where each packet's are among them."""
    import numpy as np

    grams, place = np.unique(np.concatenate([g for _, g, _ in found]), return_inverse=True)
    times = np.bincount(place, weights=np.concatenate([t for _, _, t in found]))
    return grams, np.frexp(times)[1], place  # 1 + floor(log2)


def _segment(grams: np.ndarray, level: np.ndarray, segment: int, hashes: int) -> np.ndarray:
    """A segment of the filter, packed by 8."""
    import numpy as np

    row = np.zeros(segment, bool)
    for q in range(1, int(level.max()) + 1):
        for at in _places(grams[level >= q], q, segment, hashes):
            row[at] = True
    return np.packbits(row, bitorder="little")


def filter_of(blocks: DataFrame, buckets: int, bits: int, hashes: int = HASHES) -> DataFrame:
    """The log-frequency Bloom filter, a table of the shared folder: bucket, bits (its segment, packed by 8)."""
    segment = max(64, bits // buckets // 8 * 8)

    def segments(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for bucket, found in _received(batches).items():
            grams, level, _ = _counted(found)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([_segment(grams, level, segment, hashes).tobytes()], pa.binary())})

    # A bucket is a partition, so that no task holds several.
    return written(gram_packets(blocks, buckets, False).repartitionById(buckets, F.col("bucket")).mapInArrow(segments, "bucket int, bits binary"), "filter")


def gathered(filter_: DataFrame, buckets: int, bits: int) -> np.ndarray:
    """A filter of a size that may be broadcast as one array, a row a bucket; buckets without n-grams have no bits."""
    import numpy as np

    out = np.zeros((buckets, max(64, bits // buckets // 8 * 8) // 8), np.uint8)
    for r in filter_.toLocalIterator():
        out[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def block_levels(blocks: DataFrame, buckets: int, bits: int, hashes: int = HASHES) -> DataFrame:
    """block, bucket, levels (of the block's distinct n-grams in that bucket, in their order): probes of the bucket's segment of the filter.

    A bucket's packets are moved once: its segment, the same bits as filter_of() has, is made of the
    learnt ones and probed for all where they meet.
    """
    segment = max(64, bits // buckets // 8 * 8)

    def probed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for bucket, found in _received(batches).items():
            grams, level, place = _counted(found)
            levels, end = levels_of(grams, _segment(grams, level, segment, hashes)[None], hashes).astype(np.uint8)[place], 0
            for name, own, _ in found:
                start, end = end, end + len(own)
                yield pa.RecordBatch.from_pydict({"block": [name], "bucket": pa.array([bucket], pa.int32()), "levels": pa.array([squeeze(levels[start:end].tobytes())], pa.binary())})

    # A bucket is a partition, so that no task holds several.
    return gram_packets(blocks, buckets, True).repartitionById(buckets, F.col("bucket")).mapInArrow(probed, "block string, bucket int, levels binary")


def _places(grams: np.ndarray, level: int, segment: int, hashes: int) -> Iterator[np.ndarray]:
    import numpy as np

    for k in range(hashes):
        yield (_mix(grams + np.uint64((level * 64 + k + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(segment)).astype(np.int64)


def levels_of(grams: np.ndarray, bits: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The level of each n-gram: as far as all probes of levels 1, 2, ... hit."""
    import numpy as np

    buckets, width = bits.shape
    out, alive = np.zeros(len(grams), np.int64), np.arange(len(grams))
    base = _bucket(grams, buckets) * width if buckets > 1 else np.zeros(len(grams), np.int64)
    flat = bits.reshape(-1)
    for q in range(1, 64):
        hit = np.ones(len(alive), bool)
        for at in _places(grams[alive], q, width * 8, hashes):
            hit &= (flat[base[alive] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        alive = alive[hit]
        if not len(alive):
            break
        out[alive] = q
    return out


def _middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for, the middle of 2^(q-1) .. 2^q - 1."""
    import numpy as np

    return np.where(level > 0, 0.75 * np.exp2(level.astype(np.float64)) - 0.5, 0)


def score(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, max_bits: int = MAX_FILTER_BITS, mu: float = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    blocks = blocks_of(docs, block_tokens)
    held = blocks.agg(F.sum("n_words").alias("words"), F.sum("n_pairs").alias("pairs")).head()
    words, pairs = int(held["words"] or 0), int(held["pairs"] or 0)
    word_buckets = max(partitions(spark), -(-words // BUCKET_GRAMS))
    buckets = max(LEAST_BUCKETS, -(-(words + pairs) // BUCKET_GRAMS))
    counts = written(word_counts(blocks, word_buckets), "counts")
    released(spark)
    sums = counts.agg(*(F.sum(c).alias(c) for c in ("n", "v", "levels"))).head()
    n, v = int(sums["n"] or 0), int(sums["v"] or 0)
    exact = counts.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("exact"))
    # Levels of words, and at most one bigram's entry a token.
    bits = max(1 << 12, FILTER_BITS_EACH * (pairs + int(sums["levels"] or 0)))
    if bits <= max_bits:
        filter_ = filter_of(blocks, buckets, bits)
        released(spark)
        shared = spark.sparkContext.broadcast(gathered(filter_, buckets, bits))
        dropped(filter_)
        joined = blocks.join(exact, "block").withColumn("levels", F.lit(None).cast("array<struct<bucket:int,levels:binary>>"))
    else:
        shared = None
        levels = written(block_levels(blocks, buckets, bits), "levels")
        levels = levels.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "levels"))).alias("levels"))
        joined = blocks.join(exact, "block").join(levels, "block")
    released(spark)

    def scores(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in range(batch.num_rows):
                words, names, held, lengths, ids, exact, found = (c[row].as_py() for c in batch.columns)
                hashes, size, ids = _hashes(words), np.array(lengths, np.int64), _ids(ids)
                c = np.empty(len(hashes), np.int64)
                c[np.argsort(_word_bucket(hashes, word_buckets), kind="stable")] = np.concatenate([np.frombuffer(unpack(x["counts"]), "<i8") for x in exact])
                doc = np.repeat(np.arange(len(size)), size)
                base = np.bincount(doc, weights=np.log10((c + 0.5) / (n + 0.5 * (v + 1)))[ids], minlength=len(size))
                known = np.bincount(doc, weights=(c > 0)[ids], minlength=len(size)).astype(np.int64)
                grams = _grams(hashes, ids, size)
                if shared is not None:
                    level = levels_of(grams, shared.value)
                else:
                    place = np.unique(grams, return_inverse=True)[1]
                    level = np.concatenate([np.frombuffer(unpack(x["levels"]), np.uint8) for x in found])[place]
                both, alone = _middle(level[: len(ids)]), np.minimum(_middle(level[len(ids) :]), n)
                p = (alone + 0.5) / (n + 0.5 * (v + 1))
                context = np.empty_like(ids)
                context[1:] = ids[:-1]
                context[np.cumsum(size) - size] = ids[-1]
                both = np.minimum(both, np.minimum(alone[context], alone[ids]))
                model = np.bincount(doc, weights=np.log10((both + mu * p[ids]) / (alone[context] + mu)), minlength=len(size))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(held, pa.bool_()), pa.array(size), pa.array(known), pa.array(base), pa.array(model)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    joined = joined.select("words", "doc_ids", "held_out", "lengths", "ids", "exact", "levels")
    return joined.mapInArrow(scores, SCORES).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
