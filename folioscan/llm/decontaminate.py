"""Operator 9, benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are runs of letters and digits, in lower case, so layout, case and punctuation don't hide a
passage. A seed is the hash of a mask and of the words at its 1s, laid over a window; words at its
0s may have been substituted. All windows of all documents meet all windows of all benchmark items
on the seed. Hits name diagonals, the shifts between document and item. These are made distinct as
numbers, and only documents that have one are read again, to be compared along it: the document
leaks the item if some stretch of COMPARE words (or the whole item, if shorter) has equal words in
at least EQUAL_PERCENT % of its places. Along a diagonal each word is one step, whatever the length
of a stretch. Where an item repeats itself, seeds with the same AROUND words on both sides count once.

Items of up to COMPARE words have few windows, so they also get the light SHORT_MASKS, which fit any
placement of the substitutions that EQUAL_PERCENT allows. Items of fewer than LEAST_WORDS words are
matched whole and exactly: all of their words in a row.

Equal items are compared once. Up to BROADCAST_SEEDS seeds, which are counted, are broadcast; more
meet the documents' by shuffle. The items' words are broadcast, once an item, while they are at most
BROADCAST_WORDS together, and so are up to BROADCAST_IDS diagonals.

Null texts have no words; null ids are returned as they are; repeated rows are judged alike, and
rows that share an id give one row for it. Long texts are windows like others, of which only those
that hit leave their task. Ties: the smallest item id, the best stretch. No rows, or no benchmark:
nothing leaks. Further columns of documents don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, dropped, text_of, written

#: Masks: where a word counts. Any two of them differ in most distances between 1s.
MASKS = ("11011001", "110100101", "1010011011")
COMPARE, EQUAL_PERCENT, LEAST_WORDS = 13, 75, 8
#: Of up to 13 words at least 75 % equal, 3 in a row are equal, but for one placement of two substitutions in 8 words.
SHORT_MASKS = ("111", "11011")
#: A document's diagonals of an item are dealt into so many rows at most.
SHIFT_BLOCKS = 64
#: Words on each side of a seed that make its surrounding.
AROUND = 2 * COMPARE
BROADCAST_SEEDS, BROADCAST_WORDS = 1_000_000, 4_000_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words, in order."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masks_for(n: int) -> tuple[str, ...]:
    """The masks of an item of n words."""
    if n < LEAST_WORDS:
        return ("1" * n,)
    return (*MASKS, *(SHORT_MASKS if n <= COMPARE else ()))


def seeds(frame: DataFrame, keep: list[str], masks: list[str], of_items: bool = False) -> DataFrame:
    """keep, at (from 0), seed: a row for each window of the words in column th and mask that fits; of_items: and that an item of this length has."""
    n = F.size("th")
    least = min(map(len, masks))
    windows = frame.withColumn("at", F.explode(F.when(n >= least, F.sequence(F.lit(0), n - least))))
    found = []
    for mask in masks:
        fits = F.col("at") + len(mask) <= n
        if of_items:
            lengths = [k for k in range(1, COMPARE + 2) if mask in masks_for(k)]
            fits &= F.least(n, F.lit(COMPARE + 1)).isin(lengths)
        found.append(F.when(fits, F.xxhash64(F.lit(int(mask, 2)), *(F.get("th", F.col("at") + j) for j, bit in enumerate(mask) if bit == "1"))))
    # One long to join on, whatever the mask: that is what generated code looks up fastest.
    if not of_items:
        return windows.select(*keep, "at", F.explode(F.array(*found)).alias("seed")).filter("seed IS NOT NULL")
    # A seed that repeats in an item counts once for each surrounding: others would be compared with the same words.
    before = F.least("at", F.lit(AROUND))
    around = F.xxhash64(before, F.slice("th", F.col("at") + 1 - before, before + max(map(len, masks)) + AROUND))
    rows = windows.select(*keep, "at", around.alias("around"), F.explode(F.array(*found)).alias("seed")).filter("seed IS NOT NULL")
    return rows.groupBy(*keep, "seed", "around").agg(F.min("at").alias("at")).select(*keep, "at", "seed")


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, item (what equal items share), th."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(text_of()).alias("th")).filter(F.size("th") > 0)
    return items.withColumn("item", F.xxhash64("th"))


def _sent(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _diagonals(docs: DataFrame, key: str, items: DataFrame) -> DataFrame:
    """key, text_hash, item, shifts: distinct, in blocks by remainder, in the shared folder. docs: key, text_hash, text."""
    lengths = [r["n"] for r in items.select(F.least(F.size("th"), F.lit(COMPARE + 1)).alias("n")).distinct().collect()]
    masks = list(dict.fromkeys(m for n in sorted(lengths, reverse=True) for m in masks_for(n))) or [*MASKS]
    item_seeds = seeds(items.dropDuplicates(["item"]), ["item"], masks, of_items=True).withColumnRenamed("at", "item_at")
    own = seeds(docs.select(key, "text_hash", word_hashes(F.col("text")).alias("th")), [key, "text_hash"], masks)
    hits = own.join(_sent(item_seeds, item_seeds.count() <= BROADCAST_SEEDS), "seed")
    shifts = hits.select(key, "text_hash", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    return written(shifts.groupBy(key, "text_hash", "item", F.pmod("shift", F.lit(SHIFT_BLOCKS)).alias("block")).agg(F.collect_list("shift").alias("shifts")), "diagonals")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, item_id, n_equal, n_compared: the best stretch of each leaked item in each document. A table in the shared folder."""
    items = written(items_of(benchmark), "items")
    texts = docs.select(key, text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    diagonals = _diagonals(texts, key, items)
    few = (diagonals.agg(F.sum(F.size("shifts")).alias("n")).head()["n"] or 0) <= BROADCAST_IDS
    rows = diagonals.select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash"), "item", "shifts")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("text_hash") == F.col("_hash"))
    again = texts.join(_sent(rows.select("_key", "_hash").distinct(), few), same, "left_semi").select(key, "text_hash", word_hashes(F.col("text")).alias("th"))
    words = items.dropDuplicates(["item"]).select("item", F.col("th").alias("item_th"))
    small = (items.agg(F.sum(F.size("th")).alias("n")).head()["n"] or 0) <= BROADCAST_WORDS
    lined = again.join(_sent(rows, few), same).join(_sent(words, small), "item")
    n_compared = F.least(F.lit(COMPARE), F.size("item_th"))
    # The last n_compared places as bits: one step a word, whatever stands in them.
    full = F.expr(f"shiftleft(1, least({COMPARE}, size(item_th))) - 1")
    bits = lambda acc, x: (F.shiftleft(acc["bits"], 1).bitwiseOR(x)).bitwiseAND(full)

    def along(shift: Column) -> Column:
        """The most equal words of a stretch. Only what of the item lies on the document is read: words beyond it can't be equal."""
        first, end = F.greatest(F.lit(0), -shift), F.least(F.size("item_th"), F.size("th") - shift)
        length = F.greatest(F.lit(0), end - first)
        equal = F.zip_with(F.slice("item_th", first + 1, length), F.slice("th", first + shift + 1, length), lambda a, b: (a == b).cast("int"))
        return F.aggregate(equal, F.struct(F.lit(0).alias("bits"), F.lit(0).alias("best")), lambda acc, x: F.struct(bits(acc, x).alias("bits"), F.greatest(acc["best"], F.bit_count(bits(acc, x))).alias("best")), lambda acc: acc["best"])

    # Nothing is better than a stretch that is equal throughout.
    best = F.aggregate("shifts", F.lit(0), lambda acc, shift: F.when(acc >= n_compared, acc).otherwise(F.greatest(acc, along(shift))))
    # The filter stands above the sum over diagonals, so that it can't be pushed to where it would compare once more.
    found = lined.select(key, "item", best.cast("long").alias("n_equal"), n_compared.cast("long").alias("n_compared")).groupBy(key, "item").agg(F.max("n_equal").alias("n_equal"), F.max("n_compared").alias("n_compared"))
    least = F.when(F.col("n_compared") < LEAST_WORDS, 100).otherwise(EQUAL_PERCENT)
    found = found.filter(F.col("n_equal") * 100 >= F.col("n_compared") * least)
    out = written(found.join(items.select("item", "item_id"), "item").groupBy(key, "item_id").agg(F.max("n_equal").alias("n_equal"), F.max("n_compared").alias("n_compared")), "leaks")
    for t in (items, diagonals):
        dropped(t)
    return out


def leaked_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, first_item, n_equal: one row for each document that leaks."""
    return (
        leaks(docs.select("doc_id", "text"), benchmark)
        .groupBy("doc_id")
        .agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.max("n_equal").alias("n_equal"))
    )
