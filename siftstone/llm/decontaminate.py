"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask selects in a window; the
other words may differ. Seeds of documents meet equal seeds of benchmark items,
which names an alignment. Each alignment is then verified word by word: a
window with few enough substitutions makes the document contaminated.

The masks miss no such window: whatever words are substituted, some placement
of some mask in the window avoids them all (``tests`` prove it by enumeration).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Selected word offsets.
MASKS = ((0, 1, 2, 3, 5), (0, 1, 3, 5, 6))
#: Aligned words of which at most so many may differ.
WINDOW, SUBSTITUTIONS = 13, 2
#: Items of fewer words must occur whole, word by word.
MIN_WORDS = 8
#: Rows, and words in them, up to which a side is broadcast.
BROADCAST_ROWS, BROADCAST_WORDS = 1_000_000, 4_000_000
#: Code points of scripts without spaces (Thai, Lao, Burmese, Khmer, kana, Han), of which each letter is a word: fixed values.
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"


def word_list(text: Column) -> Column:
    """Lower-case runs of letters and digits, single characters of scripts without spaces; an empty list for a null or empty text."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    spaced = F.when(lower.rlike(UNSPACED), F.regexp_replace(lower, f"({UNSPACED})", " $1 ")).otherwise(lower)
    plain = F.trim(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def whole_mask(length: int) -> tuple[int, ...]:
    """Selects all words of an item that is too short for the spaced masks."""
    return tuple(range(length))


def seed_list(words: Column, masks: tuple[tuple[int, ...], ...] = MASKS) -> Column:
    """(position, seed) of every placement of every mask."""

    def placed(number: int, mask: tuple[int, ...]) -> Column:
        last = F.size(words) - 1 - mask[-1]
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(number), *[F.get(words, i + o) for o in mask]).alias("seed")))

    # A mask's number tells it from the others; that of a whole short item is its length, less than 0.
    return F.concat(*[placed(-len(m) if m == whole_mask(len(m)) else MASKS.index(m), m) for m in masks])


def _bounded(df: DataFrame, words: str | None = None) -> DataFrame:
    """``df`` broadcast if it is small in rows, and in the words of the lists ``words``; beyond that the join shuffles."""
    if df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return df
    if words is not None and (df.agg(F.sum(F.size(words).cast("long"))).first()[0] or 0) > BROADCAST_WORDS:
        return df
    return F.broadcast(df)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Verified alignments: ``id, hash`` (of the text), ``item, doc_start`` (word of the document at which the item begins, maybe negative), ``n_matched`` (equal words), ``n_words`` (of the item)."""
    items = cut(benchmark.select(F.col(item_col).alias("item"), word_list(F.col(item_text_col)).alias("iw")).where(F.size("iw") > 0))
    short = sorted(r[0] for r in items.select(F.size("iw")).where(F.size("iw") < MIN_WORDS).distinct().collect())  # MIN_WORDS - 1 rows at most
    # A short item has the seed of all its words, a longer one those of the masks.
    own = F.when(F.size("iw") >= MIN_WORDS, seed_list(F.col("iw")))
    for n in short:
        own = own.when(F.size("iw") == n, seed_list(F.col("iw"), (whole_mask(n),)))
    seeds = _bounded(items.select("item", F.explode(own).alias("s")).select("item", F.col("s.at").alias("ipos"), F.col("s.seed").alias("seed")))
    masks = MASKS + tuple(whole_mask(n) for n in short)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), word_list(F.col(text_col)).alias("dw"))
    hits = texts.select("id", "hash", F.explode(seed_list(F.col("dw"), masks)).alias("s")).select("id", "hash", F.col("s.at").alias("pos"), F.col("s.seed").alias("seed"))
    # The alignment that a hit names; a passage's many hits name one.
    found = hits.join(seeds, "seed").groupBy("id", "hash", "item", (F.col("pos") - F.col("ipos")).alias("doc_start")).agg(F.count(F.lit(1)).alias("n_hits"))
    found = cut(found)
    keys = found.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("c")).select(F.col("id").alias("kid"), F.col("hash").alias("khash"))
    wanted = texts.join(_bounded(cut(keys)), (F.col("hash") == F.col("khash")) & F.col("id").eqNullSafe(F.col("kid")), "left_semi")
    once = wanted.groupBy("id", "hash").agg(F.first("dw").alias("dw"))
    met = found.alias("f").join(once.alias("o"), (F.col("f.hash") == F.col("o.hash")) & F.col("f.id").eqNullSafe(F.col("o.id"))).select("f.*", "o.dw")
    met = met.join(_bounded(items, "iw"), "item")
    n = F.size("iw")
    equal = F.transform(F.sequence(F.lit(0), n - 1), lambda k: (F.coalesce((F.col("doc_start") + k >= 0) & (F.get("dw", F.col("doc_start") + k) == F.get("iw", k)), F.lit(False))).cast("int"))
    width = F.least(F.lit(WINDOW), n)
    allowed = F.when(n < MIN_WORDS, F.lit(0)).otherwise(F.floor(width * F.lit(SUBSTITUTIONS) / F.lit(WINDOW)))
    met = met.withColumn("equal", equal)
    inside = F.exists(
        F.sequence(F.lit(1), n - width + 1),
        lambda s: F.aggregate(F.slice("equal", s, width), F.lit(0), lambda a, x: a + x) >= width - allowed,
    )
    return met.where(inside).select("id", "hash", "item", "doc_start", F.aggregate("equal", F.lit(0), lambda a, x: a + x).alias("n_matched"), n.alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id_col>, contaminated, n_overlaps, n_matched, item_ids``.

    Contaminated: at some alignment, 13 consecutive words of an item (all of a
    shorter one) equal the document's but for at most 2 (in proportion, rounded
    down, for a shorter one; none below 8 words, so that an item of one word marks
    every text with that word). Words are runs of letters and digits, lower-cased;
    of scripts without spaces each character is a word.
    ``item_ids`` lists the items, ``n_overlaps`` counts alignments, ``n_matched``
    is the most equal words in one. Items without words and null texts
    match nothing; other columns, whatever their names, aren't read. Rows that repeat id and text get one verdict. An empty table
    gives no rows, an empty benchmark marks nothing.
    """
    found = (
        find_overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col)
        .groupBy("id", "hash")
        .agg(F.count(F.lit(1)).alias("n"), F.max("n_matched").alias("m"), F.array_sort(F.collect_set("item")).alias("items"))
    )
    rows = docs.select(F.col(id_col).alias("own"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own_hash"))
    return rows.join(found, (F.col("own_hash") == F.col("hash")) & F.col("own").eqNullSafe(F.col("id")), "left").select(
        F.col("own").alias(id_col),
        F.col("n").isNotNull().alias("contaminated"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_overlaps"),
        F.coalesce("m", F.lit(0)).alias("n_matched"),
        F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("item_ids"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns.

    Rows that repeat id and text stay or go together, also where the id is null;
    null texts stay. Columns may have any names. Empty tables: nothing goes.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    found = find_overlaps(inner, benchmark, own, text, item_col, item_text_col).select("id", "hash").distinct()
    same = (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("hash")) & F.col(own).eqNullSafe(F.col("id"))
    return inner.join(_bounded(cut(found)), same, "left_anti").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
