"""Benchmark decontamination with DataFrame functions only.

The n-grams of the benchmark form a hash set that is broadcast while a count keeps it within its
bound, and shuffled beyond it. Every token window of every document is hashed, looked up, and a hit
is verified word by word. Documents are cut into pieces of bounded length that overlap by one window,
so that a very long text never becomes one row of windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, reliable, row_key, small_enough

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a document in one piece.
PIECE = 2048
#: Benchmark windows that may be broadcast: about 200 bytes each.
MAX_BROADCAST_WINDOWS = 250_000


def words_of(text: Column) -> Column:
    """Lower-cased words; null has none."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, n: int = 13, item_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """Distinct windows: size, words joined by a blank, and the sorted ids of the items that hold them.

    An item of fewer than n words, but not none, is one window. Items without words have none.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"),
                             words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    items = items.withColumn("size", F.least(F.lit(n), F.size("words")))
    starts = items.select("item", "size", "words", F.explode(
        F.expr("sequence(1, size(words) - size + 1)")).alias("at"))
    each = starts.select("item", "size", F.array_join(
        F.slice("words", F.col("at"), F.col("size")), " ").alias("window")).distinct()
    return each.groupBy("size", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id",
         text_col: str = "text", item_col: str = "item_id",
         benchmark_text_col: str = "text") -> DataFrame:
    """One row per document row at least, and one per verified hit.

    Columns: the id, `_row` (hash of the text), n_words, `_first` (true once per document row), at
    (0-based word position, null without hit), size (words of the window) and items.
    """
    grams = reliable(benchmark_windows(benchmark, n, item_col, benchmark_text_col))
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect()) or [n]
    key, digest = row_key(id_col, text_col)
    whole = docs.select(key.alias("_id"), digest.alias("_row"), words_of(F.col(text_col)).alias("_w"))
    pieces = whole.select("_id", "_row", F.size("_w").alias("n_words"), "_w", F.explode(
        F.expr(f"sequence(0, greatest(size(_w) - 1, 0), {PIECE})")).alias("_start"))
    shifted = F.arrays_zip(*[F.slice(F.col("_w"), F.col("_start") + (k + 1), PIECE).alias(f"w{k}")
                             for k in range(n)])
    tokens = pieces.select("_id", "_row", "n_words", "_start", F.posexplode_outer(shifted).alias("_p", "_z"))
    word = [F.col("_z")[f"w{k}"] for k in range(n)]

    def hashed(size: int) -> Column:
        return F.when(word[size - 1].isNotNull(), F.xxhash64(*word[:size]))

    place = [F.col("_id"), F.col("_row"), F.col("n_words"),
             (F.col("_start") + F.coalesce(F.col("_p"), F.lit(0))).alias("at"), F.col("_z")]
    if len(sizes) == 1:
        windows = tokens.select(*place, F.lit(sizes[0]).alias("_size"), hashed(sizes[0]).alias("_hash"))
    else:
        windows = tokens.select(*place, F.explode(F.array(*[
            F.struct(F.lit(s).alias("_size"), hashed(s).alias("_hash")) for s in sizes])).alias("_k"))
        windows = windows.select("_id", "_row", "n_words", "at", "_z", "_k._size", "_k._hash")
    gram = grams.select(F.xxhash64(*[F.get(F.split("window", " "), F.lit(k)) for k in range(n)]).alias("_hash"),
                        "size", "window", "items")
    found = windows.join(
        small_enough(gram, MAX_BROADCAST_WINDOWS),
        (windows["_hash"] == gram["_hash"]) & (F.col("_size") == F.col("size"))
        & (_joined(word, F.col("_size"), sizes) == F.col("window")), "left")
    first = (F.col("at") == 0) & (F.col("_size") == sizes[0])
    return found.where(F.col("window").isNotNull() | first).select(
        F.col("_id").alias(id_col), "_row", "n_words", first.alias("_first"),
        F.when(F.col("window").isNotNull(), F.col("at")).alias("at"), "size", "items")


def _joined(word: list[Column], size: Column, sizes: list[int]) -> Column:
    out = F.lit(None).cast("string")
    for s in sizes:
        out = F.when(size == s, F.concat_ws(" ", *word[:s])).otherwise(out)
    return out


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document row: n_words, n_hit, n_items, items, spans and contaminated.

    spans holds the word ranges that are hit, end exclusive, in order. A document is contaminated
    when at least a twentieth of its words is hit. Repeated rows each get their row.
    """
    order = Window.partitionBy(id_col, "_row").orderBy("at", "size")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("size")
    covered = found.withColumn("_end", end).withColumn("_reach", F.max("_end").over(earlier))
    covered = covered.withColumn("_new", F.when(
        F.col("at").isNotNull() & (F.col("_reach").isNull() | (F.col("_end") > F.col("_reach"))),
        F.struct(F.greatest("at", F.coalesce("_reach", "at")).alias("start"), F.col("_end").alias("end"))))
    each = covered.groupBy(id_col, "_row").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(F.when(F.col("_first"), F.lit(1)).otherwise(0)).alias("_copies"),
        F.coalesce(F.sum(F.col("_new.end") - F.col("_new.start")), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.collect_list("_new")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return each.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
                           ).withColumn("n_items", F.size("items").cast("long"))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id",
         text_col: str = "text", **columns: str) -> DataFrame:
    """Contamination of each document row, with `_row` and `_copies` to match rows again.

    Null or empty texts have no words and no hits; a null id is a value of its own; an empty
    benchmark hits nothing; columns of any other name are ignored. Rows that repeat id and text share
    one report, which `expand` repeats.
    """
    return report(hits(docs, benchmark, n, id_col, text_col, **columns), id_col)


def expand(found: DataFrame) -> DataFrame:
    return found.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = 13,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without contaminated ones, or (mode "spans") with their hit words cut out.

    Span removal cuts every hit word with the separators before it and leaves other text as it was.
    """
    bad = reliable(scan(docs, benchmark, n, id_col, text_col).where(
        "contaminated" if mode == "documents" else "n_hit > 0").select(
        F.col(id_col).alias("_id"), "_row", "spans"))
    key, digest = row_key(id_col, text_col)
    bad = small_enough(bad.drop("spans") if mode == "documents" else bad, 200_000)
    same = key.eqNullSafe(F.col("_id")) & (digest == F.col("_row"))
    if mode == "documents":
        return docs.join(bad, same, "left_anti")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(SPACED_WORD), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    tail = F.regexp_extract(F.col(text_col), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*$", 0)
    return docs.join(bad, same, "left").withColumn(text_col, F.when(
        F.col("spans").isNotNull(), F.concat(F.array_join(kept, ""), tail)).otherwise(
        F.col(text_col))).drop("_id", "_row", "spans")
