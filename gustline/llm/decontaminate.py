"""Benchmark passages in a corpus, by winnowing.

Of every five consecutive six-word grams the one of least hash is a
fingerprint, so any ten words that a document shares with an item hold a
fingerprint of both.  Items' fingerprints make a bit field of fixed size that
goes to every task; documents' fingerprints that pass it are joined with the
items' and extended word by word, which confirms the match and says which words
it covers.  An item shorter than a window is one window; each such length has
grams of its own, all of them fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.llm.rows import drop_rows, text_key, text_keys
from gustline.llm.staging import Staging
from gustline.llm.words import ALPHANUMERIC, Words, grams, longs, parts, text_bytes, words_of

#: Words of a window, and of a fingerprinted gram; each WINDOW - GRAM + 1 grams in a row give a fingerprint.
WINDOW, GRAM = 10, 6
REACH = WINDOW - GRAM
#: Bits of the field that documents' fingerprints must pass; more only saves candidates.
FIELD_BITS = 25

_CONTEXT = GRAM + 2 * REACH
_MARK = "array<struct<size:int,print:long,at:int,context:array<long>>>"


def fingerprints(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (among all words) and hashes of the fingerprints for windows of ``size`` words."""
    if size < WINDOW:
        value, whole = grams(words, size)
        at = np.flatnonzero(whole)
        return at, value[at]
    value, _ = grams(words, GRAM)
    width = REACH + 1
    if len(value) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(value, width).argmin(axis=1) + np.arange(len(value) - width + 1)
    one = words.document[: len(least)] == words.document[WINDOW - 1 : WINDOW - 1 + len(least)]
    at = np.unique(least[one])
    return at, value[at]


def _contexts(words: Words, at: np.ndarray, size: int, pad: int) -> np.ndarray:
    """Hashes of the words around each fingerprint, as far as a window through it can reach."""
    before = REACH if size == WINDOW else 0
    width = _CONTEXT if size == WINDOW else size
    index = at[:, None] + np.arange(-before, width - before)
    held = np.clip(index, 0, len(words.hashes) - 1)
    inside = (index == held) & (words.document[held] == words.document[at][:, None])
    return np.where(inside, words.hashes[held].view(np.int64), pad)


def _marks(words: Words, sizes: list[int], pad: int, field: np.ndarray | None) -> tuple[np.ndarray, pa.Array]:
    """Per document, its fingerprints as a list column."""
    documents, columns = [], []
    first = words.first
    for size in sizes:
        at, value = fingerprints(words, size)
        if field is not None:
            slot = (value & np.uint64((1 << FIELD_BITS) - 1)).astype(np.int64)
            passed = (field[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
            at, value = at[passed], value[passed]
        if pad == ITEM and size < WINDOW:  # an item's only window
            lone = words.counts[words.document[at]] == size
            at, value = at[lone], value[lone]
        document = words.document[at]
        documents.append(document)
        columns.append((np.full(len(at), size, np.int32), value, at - first[document], _contexts(words, at, size, pad)))
    document = np.concatenate(documents)
    order = np.argsort(document, kind="stable")
    sizes_, values, places = (np.concatenate([c[i] for c in columns])[order] for i in range(3))
    lists = [row for c in columns for row in c[3]]
    context = pa.array([lists[i] for i in order.tolist()], pa.list_(pa.int64()))
    rows = pa.StructArray.from_arrays(
        [pa.array(sizes_, pa.int32()), longs(values), pa.array(places.astype(np.int32)), context],
        ["size", "print", "at", "context"],
    )
    offsets = np.zeros(len(words.counts) + 1, np.int32)
    np.cumsum(np.bincount(document, minlength=len(words.counts)), out=offsets[1:])
    return words.counts, pa.ListArray.from_arrays(pa.array(offsets), rows)


#: What stands for words before the first and after the last; differs, so that it never matches.
DOCUMENT, ITEM = 1, 2


def marked(texts: DataFrame, id_column: str, pad: int, sizes: list[int], field=None) -> DataFrame:
    """id, key (a hash of the text), n_words and marks (fingerprints with the words around them) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = field.value if field is not None else None
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in parts(offsets):
                own = offsets[a : b + 1] - offsets[a]
                piece = data[offsets[a] : offsets[b]]
                keys = text_keys(piece, own)
                counts, marks = _marks(words_of(piece, own, ALPHANUMERIC), sizes, pad, bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), longs(keys), pa.array(counts), marks],
                    ["id", "key", "n_words", "marks"],
                )

    kind = dict(texts.dtypes)[id_column]
    return texts.select(F.col(id_column).alias("id"), "text").mapInArrow(
        run, f"id {kind}, key long, n_words long, marks {_MARK}"
    )


def _field(items: DataFrame):
    """The bits that items' fingerprints set; at most 2 ** FIELD_BITS / 64 rows reach the driver."""
    slot = F.col("m.print").bitwiseAND(F.lit((1 << FIELD_BITS) - 1))
    words = (
        items.select(F.explode("marks").alias("m"))
        .select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(m.print & 63L as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    field = np.zeros(1 << (FIELD_BITS - 6), np.int64)
    field[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return items.sparkSession.sparkContext.broadcast(field.view(np.uint64))


def _run_length(same: Column, order: list[int]) -> Column:
    """How many of the given places, in order, match before the first that doesn't."""
    length = F.lit(len(order))
    for n in reversed(range(len(order))):
        length = F.when(~F.get(same, F.lit(order[n])), F.lit(n)).otherwise(length)
    return length


def find_overlaps(docs: DataFrame, benchmark: DataFrame, staging: Staging | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and key (a hash of the text) of every row of ``docs``.

    Reads ``doc_id`` and ``text`` of documents, ``item_id`` and ``text`` of items; other columns may have any name.
    Words are runs of ASCII letters and digits and of anything beyond ASCII, capitals A-Z as small letters.  A window
    is ten consecutive words of an item, or the whole of a shorter one; a word of a document inside any occurrence of a
    window is hit.  A null or empty text has no words, matches nothing and is not contaminated.  Repeated items count
    once, by id; a null item_id counts as the empty string.  Repeated rows of ``docs`` are reported each.  With an empty
    benchmark nothing is hit; an empty ``docs`` gives no rows.

    ``items_sha256`` is over the ids found, sorted as strings and joined by commas.
    """
    staging = staging or Staging(docs.sparkSession)
    lengths = marked(benchmark, "item_id", ITEM, [WINDOW]).select("n_words").distinct().filter(f"n_words < {WINDOW}")
    sizes = [WINDOW, *sorted(r.n_words for r in lengths.collect() if r.n_words)]  # ten values at most
    items = staging.table(marked(benchmark, "item_id", ITEM, sizes), "items")
    rows = staging.table(marked(docs, "doc_id", DOCUMENT, sizes, _field(items)), "documents")
    item_marks = items.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("item"), F.explode("marks").alias("m")
    ).select("item", F.col("m.size").alias("size"), F.col("m.print").alias("print"), F.col("m.context").alias("theirs"))
    item_marks = item_marks.distinct()
    found = rows.select("id", "key", F.explode("marks").alias("m")).select("id", "key", "m.*")
    same = F.zip_with("context", "theirs", lambda x, y: x == y)
    joined = found.join(item_marks, ["size", "print"]).withColumn("same", same)
    short = F.col("size") < WINDOW
    core = F.when(short, F.forall("same", lambda x: x)).otherwise(
        F.forall(F.slice("same", REACH + 1, GRAM), lambda x: x)
    )
    left = F.when(short, 0).otherwise(_run_length(F.col("same"), list(range(REACH - 1, -1, -1))))
    right = F.when(short, 0).otherwise(_run_length(F.col("same"), list(range(REACH + GRAM, _CONTEXT))))
    gram = F.when(short, F.col("size")).otherwise(GRAM)
    hits = (
        joined.filter(core)
        .select("id", "key", "item", "size", (F.col("at") - left).alias("start"), (F.col("at") + gram + right).alias("end"))
        .filter(F.col("end") - F.col("start") >= F.col("size"))
    )
    hits = staging.table(hits.select("id", "key", "item", "start", "end").distinct(), "hits")
    spans = (
        hits.select("id", "key", "start", "end")
        .distinct()
        .groupBy("id", "key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["upto"], x["end"]).alias("upto"),
            (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["upto"], x["start"]))).alias("n"),
        ),
        lambda s: s["n"],
    )
    listed = (
        hits.select("id", "key", "item")
        .distinct()
        .groupBy("id", "key")
        .agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    )
    per_document = spans.select("id", "key", covered.alias("n_hit")).join(
        listed.withColumnsRenamed({"id": "_id", "key": "_key"}),
        F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")),
    )
    per_document = per_document.select(
        F.col("id").alias("_id"), F.col("key").alias("_key"), "n_hit", "n_items", "items"
    )
    back = rows.select("id", "key", "n_words").join(
        per_document, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left"
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return back.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "key",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    hit = find_overlaps(docs, benchmark).filter("contaminated").select("doc_id", "key")
    return drop_rows(docs, hit, text_key())
