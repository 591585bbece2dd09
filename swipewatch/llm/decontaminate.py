"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

Every run of ``window`` consecutive words of an item is a window; a shorter item is one window.
A window is the set of its shingles (``shingle`` consecutive words, or the whole window if it is
shorter). Shingles are ordered by rarity in the documents. For containment of the whole window the
necessary prefix is one shingle, the rarest: a document that holds the window holds it. So only
that shingle is joined. Its place in the window gives where the window would start; that place and
the window's length must lie within the document (positional and length bound), and then the words
are compared one by one.

The prefix table has one row per different window. It is broadcast if it is counted to have at most
``BROADCAST_ROWS`` rows; otherwise documents' shingles are shuffled together with the words around
them, never with the whole text.

Null texts have no words. Documents equal in id and text get equal rows. Items equal in id and text
count once; null item ids appear as the empty string. Windows that occur in several items are
searched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipewatch.llm.shared import BROADCAST_ROWS, fresh_name, stored, whole_text

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of ``text`` after lower-casing A-Z: digits, letters and all beyond ASCII."""
    # for plain ASCII both ways are the same; lower() is the faster one
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def windows_of(items: DataFrame, id_: str, text: str, window: int) -> DataFrame:
    """(item, words, n) of all windows, each once per item."""
    words = items.select(
        F.coalesce(F.col(id_).cast("string"), F.lit("")).alias("item"), words_of(whole_text(text)).alias("w")
    ).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return (
        words.select("item", "w", n.alias("n"), F.explode(starts).alias("at"))
        .select("item", F.slice("w", F.col("at"), F.col("n")).alias("words"), "n")
        .distinct()
    )


def _hash(parts: list) -> Column:
    """Of the words in a row; a shingle's number of words is part of it."""
    return F.xxhash64(F.lit(len(parts)), *parts)


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(words, n, at, size, print) for each shingle of each different window; ``at`` from 0."""
    out = []
    for size in range(1, shingle + 1):
        fits = windows.where(F.col("n") == size if size < shingle else F.col("n") >= size)
        at = fits.select("words", "n", F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("at"))
        parts = [F.element_at("words", F.col("at") + k + 1) for k in range(size)]
        out.append(at.select("words", "n", "at", F.lit(size).alias("size"), _hash(parts).alias("print")))
    return _union(out)


def _union(parts: list) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _document_shingles(tokens: DataFrame, sizes: list, keep: list) -> list:
    """Per size one row per shingle: ``keep``, ``at`` (from 0), ``print``.

    What follows on each frame is generated into the same code span, where a kept word array is
    only looked at; a union in between would copy the array for every shingle.
    """
    out = []
    for size in sizes:
        shifted = [F.col("w").alias("s0")] + [
            F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0))).alias(f"s{k}") for k in range(1, size)
        ]
        long_enough = tokens.where(F.size("w") >= size)
        each = long_enough.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("at", "s"))
        parts = [F.col("s")[f"s{k}"] for k in range(size)]
        each = each.where(parts[-1].isNotNull()) if size > 1 else each
        out.append(each.select(*keep, "at", _hash(parts).alias("print")))
    return out


def hits(
    docs: DataFrame, items: DataFrame, id_: str, text: str, item_id: str, item_text: str, window: int, shingle: int
) -> DataFrame:
    """(id, mark, n_hit, item set) of documents that hold a window; ``mark`` tells texts of one id apart."""
    windows = stored(windows_of(items, item_id, item_text, window), "windows")
    shingles = stored(_window_shingles(windows.select("words", "n").distinct(), shingle), "shingles")
    sizes = [r[0] for r in shingles.select("size").distinct().collect()]  # at most ``shingle`` rows
    if not sizes:
        return None
    tokens = docs.select(
        F.col(id_).alias("id"), F.xxhash64(text).alias("mark"), words_of(whole_text(text)).alias("w")
    )
    wanted = shingles.select("print").distinct()
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    # rarity: how often each shingle of the windows is in the documents
    stream = _union([each.select("print") for each in _document_shingles(tokens, sizes, [])])
    counted = stream.join(F.broadcast(wanted) if few else wanted, "print", "left_semi").groupBy("print").count()
    order = F.struct(F.coalesce("count", F.lit(0)).alias("rarity"), F.col("at"), F.col("print"))
    prefix = (
        shingles.join(counted, "print", "left")
        .groupBy("words", "n")
        .agg(F.min(order).alias("o"))
        .where("o.rarity > 0")  # a window whose rarest shingle is nowhere is nowhere
        .select("words", "n", F.col("o.at").alias("shift"), F.col("o.print").alias("print"))
    )
    prefix = stored(prefix, "prefix")

    begin, n = F.col("at") - F.col("shift"), F.col("n")
    few = prefix.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    parts = []
    for each in _document_shingles(tokens, sizes, ["id", "mark", "w"]):
        if few:
            near, base = each.join(F.broadcast(prefix), "print"), F.lit(0)
        else:
            # the words around each shingle travel with it: ``base`` is the place of the first of them
            base = F.greatest(F.col("at") - window + 1, F.lit(0))
            around = F.slice("w", base + 1, 2 * window)
            near, base = each.select("id", "mark", "at", "print", base.alias("base"), around.alias("w")).join(prefix, "print"), F.col("base")
        bounded = near.where((begin >= 0) & (begin - base + n <= F.size("w")))
        same = F.slice("w", begin - base + 1, n) == F.col("words")
        parts.append(bounded.where(same).select("id", "mark", begin.alias("begin"), "n", "words"))
    found = _union(parts).distinct()
    found = stored(found, "found")

    # words covered: intervals in order, each adding what lies beyond the ones before it
    spans = F.array_sort(F.collect_list(F.struct("begin", (F.col("begin") + F.col("n")).alias("end"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["begin"], a["upto"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(a["upto"], s["end"]).alias("upto"),
        ),
        lambda a: a["n"],
    )
    by_doc = found.groupBy("id", "mark").agg(covered.alias("n_hit"))
    of_item = found.select("id", "mark", "words").distinct().join(windows.select("item", "words"), "words")
    by_item = of_item.groupBy("id", "mark").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = (by_doc["id"].eqNullSafe(by_item["id"])) & (by_doc["mark"] == by_item["mark"])
    return by_doc.join(by_item, both).select(by_doc["id"], by_doc["mark"], "n_hit", "items")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shingle: int = 3,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items (sorted ids), contaminated."""
    number = F.size(words_of(whole_text(text))).cast("long")
    rows = docs.select(F.col(id_).alias("id"), F.xxhash64(text).alias("mark"), number.alias("n_words"))
    found = hits(docs, items, id_, text, item_id, item_text, window, shingle)
    none = F.array().cast("array<string>")
    if found is None:
        out = rows.withColumn("n_hit", F.lit(0).cast("long")).withColumn("items", none)
    else:
        f = found.select(F.col("id").alias("f_id"), F.col("mark").alias("f_mark"), "n_hit", "items")
        out = rows.join(f, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("mark") == F.col("f_mark")), "left")
    n_hit, items_ = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", none)
    return out.select(
        F.col("id").alias(id_),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        items_.alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shingle: int = 3,
) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    found = hits(docs, items, id_, text, item_id, item_text, window, shingle)
    if found is None:
        return docs
    gone = stored(found.select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else gone
    mark = fresh_name(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64(text))
    same = marked[id_].eqNullSafe(gone["gone_id"]) & (marked[mark] == gone["gone_mark"])
    return marked.join(gone, same, "left_anti").drop(mark)
