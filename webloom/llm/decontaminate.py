"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Texts and benchmark items become lower-case words without punctuation, and words become
64-bit hashes.  A mask is a fixed pattern of word positions; the words under
its ones are hashed together and those under its zeros are ignored, so a
substituted word there does not hide a passage.  Seeds of texts are joined
with seeds of items; around each hit the text and the item are laid side by
side and compared word by word.  A document is contaminated if, in some
window of ``WINDOW`` aligned words of an item (the whole item, if that is
shorter), at least ``MIN_SHARE`` of the words are equal.

The masks for an item's length leave no gap: wherever in a window the words
stand that the share lets differ (two of 11 to 13), some mask fits between
them, so every overlap that reaches the share is met by a seed.

A mask holds two neighbouring ones.  A text's seeds are made only where the
two words there are neighbours in some item as well; a bit table of fixed size tells, which
never misses a pair (others that it lets pass are met by the join).  So
the join gets few rows, and the planner may choose any kind of join; texts
are never shuffled unless very many documents have hits.

Items of ``MIN_ITEM_WORDS`` to 10 words have masks of their own, which fit
beside any one substituted word (two of 10), as the share allows.  Shorter
items are too common inside a text to tell anything; they are met where they
are the whole text, by one hash of all its words.

Defined results: a null or empty text is clean; each text is judged by
itself, also where rows share a doc_id or have none; items with equal
words count as one, named by the least item_id; an empty benchmark or an
empty table gives clean documents or no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import checkpointed, written

# Ones are the word positions that are hashed; zeros are ignored.  By the least length of an item:
# each family fits beside any substituted words that the share allows in a window of so many words:
# two of 10 to 13, one of 6 to 9.
MASKS = {13: ("11101011", "110100111"), 11: ("1111011", "110001111", "1101100011"), 10: ("11111", "111011", "11010011"),
         9: ("111111", "1110111"), 8: ("11111", "111011"), 7: ("11111", "111101", "110111"), 6: ("1111", "11011")}
MIN_ITEM_WORDS = 6
WINDOW = 13
MIN_SHARE = 0.8
TABLE_BITS = 18                 # the bit table has 2**18 bits, whatever the benchmark's size
# Everything that parts words: ASCII signs and white space, and common signs beyond ASCII.
SIGNS = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and c != 32) + "\u00a0«»“”„‘’‚…–—¿¡·"


def words(text: Column) -> Column:
    """Hashes of the words.  Splitting by one character is the fast way in the JVM."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), SIGNS, " " * len(SIGNS))
    return F.array_remove(F.transform(F.split(plain, " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _digest() -> Column:
    """Tells the texts of one doc_id, or of none, apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _same(a: DataFrame, b: DataFrame) -> Column:
    """Equal text of an equal doc_id, null included; ``a`` has the columns _id and _digest."""
    return (a["_digest"] == b["digest"]) & a["_id"].eqNullSafe(b["doc_id"])


def _seed(h: Column, mask: str, number: int, pair: Column) -> Column:
    """The hash under a mask whose first two neighbouring ones are at ``pair``.

    Words beyond either end count as missing; such a seed equals no item's, or
    is refused when the words are compared.
    """
    first = pair - F.lit(mask.index("11"))
    return F.xxhash64(F.lit(number), *[F.get(h, first + F.lit(i)) for i, c in enumerate(mask) if c == "1"])


def _seeds(h: Column, masks: dict[int, str], pairs: Column, short: int) -> Column:
    """(at, seed) of each mask at each of the places of pairs; of a text below ``short`` words also its own."""
    whole = F.filter(_whole(h), lambda x: F.size(h).between(1, short - 1))
    return F.concat(whole, *[_one_mask(h, m, k, pairs) for k, m in masks.items()])


def _one_mask(h: Column, mask: str, number: int, pairs: Column) -> Column:
    return F.transform(pairs, lambda i: F.struct(i.alias("at"), _seed(h, mask, number, i).alias("seed")))


def _whole(h: Column) -> Column:
    """The one seed of a short text or item: all its words, at place 0."""
    return F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.lit(-1), h).alias("seed")))


def _places(h: Column) -> Column:
    """0 to the last place that has a neighbour."""
    n = F.size(h)
    return F.when(n > 1, F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _pair(h: Column, i: Column) -> Column:
    return F.get(h, i).bitwiseXOR(F.shiftright(F.get(h, i + F.lit(1)), 7))


def items(benchmark: DataFrame) -> DataFrame:
    """Items with different words: item_id, h, n."""
    return (benchmark.select("item_id", words(F.col("text")).alias("h"))
            .where(F.size("h") > 0)
            .groupBy("h").agg(F.min("item_id").alias("item_id"))
            .select("item_id", "h", F.size("h").alias("n")))


def pair_table(found: DataFrame) -> Column:
    """The bit table of the items' neighbouring words, an array literal of 2**(TABLE_BITS - 6) longs."""
    h = F.col("h")
    rows = (found.select(F.explode(F.transform(_places(h), lambda i: _pair(h, i))).alias("p"))
            .select(_cell("p").alias("cell"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
            .groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect())
    table = [0] * (1 << (TABLE_BITS - 6))
    for r in rows:
        table[r.cell] = r.bits
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def _cell(p: str) -> Column:
    return F.shiftrightunsigned(p, 64 - (TABLE_BITS - 6)).cast("int")


def _known(table: Column, pair: Column) -> Column:
    cell = F.shiftrightunsigned(pair, 64 - (TABLE_BITS - 6)).cast("int")
    bit = pair.bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftright", F.get(table, cell), bit).bitwiseAND(F.lit(1)) == 1


def masks_of(n: int, masks: dict[int, tuple[str, ...]] = MASKS) -> tuple[str, ...]:
    """The masks for items of n words: of the greatest length up to n."""
    return masks[max(k for k in masks if k <= n)]


def item_seeds(found: DataFrame, masks: dict[int, tuple[str, ...]] = MASKS) -> tuple[DataFrame, dict[int, str]]:
    """(item_id, at, seed), and the masks that items have need of.

    There are fewer short lengths than the greatest length of ``masks``.
    """
    most, short = max(masks), min(masks)
    lengths = [r.n for r in found.where(F.col("n") >= short).select(F.least("n", F.lit(most)).alias("n")).distinct().collect()]
    users: dict[str, list[int]] = {}
    for n in sorted(lengths, reverse=True):
        for m in masks_of(n, masks):
            users.setdefault(m, []).append(n)
    if not users:
        users = {m: [most] for m in masks[most]}        # an empty benchmark
    every = dict(enumerate(users))
    h = F.col("h")
    rows = found.where(F.col("n") < short).select("item_id", F.explode(_whole(h)).alias("x"))
    for k, m in every.items():
        # A seed that reaches beyond the item is of no use.
        fits = F.transform(F.filter(_places(h), _inside(m)), lambda i: i)
        own = found.where(F.least("n", F.lit(most)).isin(users[m]))
        rows = rows.unionByName(own.select("item_id", F.explode(_one_mask(h, m, k, fits)).alias("x")))
    return rows.select("item_id", "x.at", "x.seed"), every


def _inside(mask: str):
    first = mask.index("11")
    return lambda i: (i >= first) & (i - first + len(mask) <= F.col("n"))


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: dict[int, tuple[str, ...]] = MASKS,
             window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """Verified overlaps: doc_id, digest (of the text), item_id, shift (place of the item's first word), share."""
    found = checkpointed(items(benchmark))
    seeds, every = item_seeds(found, masks)
    seeds = written(seeds)
    short = min(masks)
    table = pair_table(found.where(F.col("n") >= short))
    h = F.col("h")
    # The outer form: for the inner one the optimizer infers a filter on the list's size, and moves
    # it, with all that makes the list, below the projections.
    probe = (docs.select("doc_id", _digest().alias("digest"), words(F.col("text")).alias("h"))
             .select("doc_id", "digest", "h", F.filter(_places(h), lambda i: _known(table, _pair(h, i))).alias("pairs"))
             .select("doc_id", "digest", F.explode_outer(_seeds(h, every, F.col("pairs"), short)).alias("x"))
             .where("x is not null").select("doc_id", "digest", "x.at", "x.seed"))
    # Distinct seeds first: a seed that very many items share does not multiply what is probed.
    hits = probe.join(written(seeds.select("seed").distinct()), "seed")
    places = (hits.withColumnRenamed("at", "doc_at")
              .join(seeds.withColumnRenamed("at", "item_at"), "seed")
              .select("doc_id", "digest", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct())
    # As a written table its size is known: Spark broadcasts it only below its threshold.
    places = written(places)
    found_in = places.select("doc_id", "digest").distinct()
    named = docs.select(F.col("doc_id").alias("_id"), _digest().alias("_digest"), "text")
    # Of rows with the same id and text one is enough; only texts with hits are made distinct.
    texts = (named.join(found_in, _same(named, found_in), "left_semi")
             .dropDuplicates(["_id", "_digest"]).select("_id", "_digest", words(F.col("text")).alias("_h")))
    pairs = (texts.join(places, _same(texts, places)).join(found, "item_id")
             .where((F.col("n") >= short) | (F.col("_h") == F.col("h"))))
    equal = pairs.select("doc_id", "digest", "item_id", "shift", "n", F.transform(F.col("h"), lambda w, i: F.when(
        (i + F.col("shift") >= 0) & F.coalesce(F.get("_h", i + F.col("shift")) == w, F.lit(False)), 1)
        .otherwise(0)).alias("eq"))
    width = F.least(F.lit(window), F.col("n"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n") - width + 1), lambda i: F.aggregate(
        F.slice("eq", i, width), F.lit(0), lambda s, x: s + x)))
    return (equal.select("doc_id", "digest", "item_id", "shift", (best / width).alias("share"))
            .where(F.col("share") >= min_share).distinct())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contaminated texts: doc_id, digest, n_items, item_id (the least), share (the highest)."""
    return (overlaps(docs, benchmark).groupBy("doc_id", "digest")
            .agg(F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("item_id"),
                 F.max("share").alias("share")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, n_items, item_id, share (0 if clean)."""
    found = written(contaminated(docs, benchmark))
    ids = docs.select(F.col("doc_id").alias("_id"), _digest().alias("_digest"))
    return (ids.join(found, _same(ids, found), "left")
            .select(F.col("_id").alias("doc_id"), F.col("n_items").isNotNull().alias("contaminated"),
                    F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id",
                    F.coalesce("share", F.lit(0.0)).alias("share")))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns unchanged."""
    found = written(contaminated(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")))
    same = (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_digest"]) & docs["doc_id"].eqNullSafe(found["_id"])
    return docs.join(found, same, "left_anti")
