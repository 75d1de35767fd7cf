"""Ranked lexical search over an inverted index in shards, by a hybrid of term-at-a-time and document-at-a-time.

The index is a table with one row for each shard of documents: its terms with
their postings, documents in order of arrival.  A search takes its items in
blocks of bounded size.  In each shard the short posting lists of an item are
summed into accumulators; these then count as one more iterator, bounded by the
largest sum, beside the long lists.  Documents are walked in order: lists whose
bounds together can't reach the worst score still kept only get looked up for
documents that the others bring, and skip over all else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gustline.llm.staging import Staging, bound_batches
from gustline.llm.words import ALPHANUMERIC, longs, parts, text_bytes, words_of

#: A shard is closed at so many documents or postings (one document more may pass the latter).
SHARD_DOCS, SHARD_POSTINGS = 1 << 13, 1 << 20
#: Distinct (item, term) pairs that one pass over the index serves; a single larger item goes alone.
BLOCK_TERMS = 1 << 18
#: Lists of at most this share of a shard's documents are summed beforehand.
SHORT_SHARE = 1 / 16
#: Documents walked between two looks at the worst score kept.
STRIDE = 1 << 11

#: Writer's options of an index.  A task decodes all rows of a row group at once, of which each may hold 10 MB: so one
#: shard is a row group, and memory doesn't grow with the shards that a file has.
INDEX_OPTIONS = {"parquet.block.row.count.limit": "1"}

INDEX_SCHEMA = "docs array<long>, lengths array<long>, terms array<long>, ends array<int>, at array<int>, counts array<int>"


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _counted(hashes: np.ndarray, document: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, document) pairs in that order, and how often each occurs."""
    terms, which = np.unique(hashes, return_inverse=True)
    pairs = which * np.int64(max(n, 1)) + document
    pairs.sort()
    start = _runs(pairs)
    pairs, counts = pairs[start], np.diff(np.append(start, len(pairs)))
    return terms[pairs // max(n, 1)], pairs % max(n, 1), counts


class _Building:
    """The shard that a task is filling."""

    def __init__(self):
        self.docs, self.lengths, self.postings, self.n, self.size = [], [], [], 0, 0

    def add(self, docs: pa.Array, lengths: np.ndarray, terms: np.ndarray, at: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append(docs)
        self.lengths.append(lengths)
        self.postings.append((terms, at + self.n, counts))
        self.n += len(lengths)
        self.size += len(terms)

    def row(self) -> pa.RecordBatch:
        terms, at, counts = (np.concatenate(p) for p in zip(*self.postings))
        order = np.argsort(terms, kind="stable")
        terms, at, counts = terms[order], at[order], counts[order]
        start = _runs(terms)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        cells = [
            pa.concat_arrays(self.docs),
            pa.array(np.concatenate(self.lengths)),
            longs(terms[start]),
            pa.array(np.append(start[1:], len(terms)).astype(np.int32)),
            pa.array(at.astype(np.int32)),
            pa.array(counts.astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays([one(c) for c in cells], ["docs", "lengths", "terms", "ends", "at", "counts"])


def _index(batches: Iterator[pa.RecordBatch], most_docs: int, most_postings: int) -> Iterator[pa.RecordBatch]:
    shard = _Building()
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ids = batch.column("doc_id")
        for a, b in parts(offsets):
            words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALPHANUMERIC)
            some = np.flatnonzero(words.counts)
            if not len(some):
                continue
            place = np.cumsum(words.counts > 0) - 1
            found = _counted(words.hashes, place[words.document], len(some))
            shard.add(ids.slice(a, b - a).take(pa.array(some)), words.counts[some], *found)
            if shard.n >= most_docs or shard.size >= most_postings:
                yield shard.row()
                shard = _Building()
    if shard.n:
        yield shard.row()


def index_documents(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """Shards of an inverted index of ``docs``; reads ``doc_id`` (integer) and ``text`` alone.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, of the whole text, only A-Z made
    small; they are kept as 64-bit hashes.  Documents without a term, null and empty texts among them, are in no
    shard.  Repeated rows are documents of their own.  An empty table gives an empty index.  A shard holds ``shard_docs``
    documents or ``shard_postings`` postings and one part of a batch more at most, so a row of the index is bounded but
    for the distinct terms of a single document.  Write it with INDEX_OPTIONS, which keep its rows apart.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(lambda batches: _index(batches, shard_docs, shard_postings), INDEX_SCHEMA)


@dataclass
class _Block:
    """Items of one pass: their distinct terms, and for each item its terms' places there and how often it has them."""

    terms: np.ndarray
    items: list
    places: list[np.ndarray]
    repeats: list[np.ndarray]
    weights: np.ndarray | None = None
    documents: int = 0
    length: int = 0


@dataclass
class _Best:
    """The best documents of an item so far: highest score first, then least doc_id, null last."""

    k: int
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    absent: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    docs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def least(self) -> int:
        """The least score that may still enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, absent: np.ndarray, docs: np.ndarray) -> None:
        scores, absent = np.concatenate([self.scores, scores]), np.concatenate([self.absent, absent])
        docs = np.concatenate([self.docs, docs])
        order = np.lexsort((docs, absent, -scores))[: self.k]
        self.scores, self.absent, self.docs = scores[order], absent[order], docs[order]


class _Shard:
    """Postings of a block's terms in one row of the index, as impacts: what one unit of weight is worth."""

    def __init__(self, row: dict[str, pa.Array], block: _Block):
        ids = row["docs"]
        self.absent = np.asarray(ids.is_null())
        self.docs = np.asarray(ids.fill_null(0))
        lengths = np.asarray(row["lengths"])
        terms = np.asarray(row["terms"]).view(np.uint64)
        ends = np.asarray(row["ends"]).astype(np.int64)
        place = np.minimum(np.searchsorted(terms, block.terms), max(len(terms) - 1, 0))
        here = np.flatnonzero((terms[place] == block.terms) & (block.weights > 0))
        start = np.concatenate([[0], ends[:-1]])[place[here]]
        sizes = ends[place[here]] - start
        self.ends = np.cumsum(sizes)
        chosen = np.arange(sizes.sum()) + np.repeat(start - (self.ends - sizes), sizes)
        self.at = np.asarray(row["at"])[chosen].astype(np.int64)
        counts = np.asarray(row["counts"])[chosen].astype(np.int64)
        norm = 25 + (75 * lengths * block.documents) // block.length
        self.impacts = (1_000_000_000 * counts) // (1000 * counts + 8 * norm[self.at])
        self.place = np.full(len(block.terms), -1)
        self.place[here] = np.arange(len(here))
        self.bounds = np.maximum.reduceat(self.impacts, self.ends - sizes) if len(here) else np.zeros(0, np.int64)

    def lists(self, places: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Documents, contributions and their bound, for those of the terms that occur here."""
        found = []
        for p, w in zip(self.place[places].tolist(), weights.tolist()):
            if p >= 0 and w > 0:
                span = slice(self.ends[p - 1] if p else 0, self.ends[p])
                found.append((self.at[span], w * self.impacts[span], int(w * self.bounds[p])))
        return found

    def accumulate(self, lists: list) -> list:
        """The lists with the short ones replaced by one that holds their sums, by ascending bound."""
        short = [x for x in lists if len(x[0]) <= SHORT_SHARE * len(self.docs)]
        kept = [x for x in lists if len(x[0]) > SHORT_SHARE * len(self.docs)]
        if short:
            sums = np.zeros(len(self.docs), np.int64)
            for at, worth, _ in short:
                sums[at] += worth
            at = np.flatnonzero(sums)
            kept.append((at, sums[at], int(sums.max())))
        return sorted(kept, key=lambda x: x[2])

    def rank(self, lists: list, best: _Best, stride: int = STRIDE) -> None:
        """Walks the documents in order, a stride at a time, and gives ``best`` all that may belong there."""
        reach = np.cumsum([bound for _, _, bound in lists])
        for low in range(0, len(self.docs), stride):
            least = best.least
            first = int(np.searchsorted(reach, least))  # the lists before this one can't reach it together
            if first == len(lists):
                return
            high = min(low + stride, len(self.docs))
            sums = np.zeros(high - low, np.int64)
            for at, worth, _ in lists[first:]:
                a, b = np.searchsorted(at, (low, high))
                sums[at[a:b] - low] += worth[a:b]
            at_hand = np.flatnonzero(sums)
            scores = sums[at_hand]
            for i in range(first - 1, -1, -1):
                able = scores + reach[i] >= least
                at_hand, scores = at_hand[able], scores[able]
                if not len(at_hand):
                    break
                at, worth, _ = lists[i]
                where = np.minimum(np.searchsorted(at, at_hand + low), len(at) - 1)
                scores = scores + np.where(at[where] == at_hand + low, worth[where], 0)
            able = scores >= least
            if able.any():
                rows = at_hand[able] + low
                best.add(scores[able], self.absent[rows], self.docs[rows])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    for batch in batches:
        for i in range(len(batch)):
            yield {name: batch.column(name).slice(i, 1).flatten() for name in batch.schema.names}


def _frequencies(index: DataFrame, block: _Block) -> np.ndarray:
    """In how many documents each term of the block occurs; reads the terms and sizes of lists alone."""
    sent = index.sparkSession.sparkContext.broadcast(block.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        total = np.zeros(len(wanted), np.int64)
        for row in _rows(batches):
            terms, ends = np.asarray(row["terms"]).view(np.uint64), np.asarray(row["ends"])
            if len(terms):
                place = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                total += np.where(terms[place] == wanted, np.diff(ends, prepend=0)[place], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "n"])

    counts = index.select("terms", "ends").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found = np.zeros(len(block.terms), np.int64)
    for row in counts.collect():
        found[row.place] = row.n
    sent.unpersist()
    return found


def _search_block(index: DataFrame, block: _Block, k: int, id_type) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(block)
    arrow_type = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        weights = [block.weights[p] * n for p, n in zip(block.places, block.repeats)]
        best = [_Best(k) for _ in block.items]
        for row in _rows(batches):
            shard = _Shard(row, block)
            for mine, places, worth in zip(best, block.places, weights):
                lists = shard.lists(places, worth)
                if lists:
                    shard.rank(shard.accumulate(lists), mine)
        for item, mine in zip(block.items, best):
            if len(mine.scores):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(mine.scores), arrow_type),
                        pa.array(mine.docs, mask=mine.absent),
                        pa.array(mine.scores),
                    ],
                    ["item_id", "doc_id", "score"],
                )

    return index.mapInArrow(run, f"item_id {id_type.simpleString()}, doc_id long, score long")


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id and its terms with their number, one row for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in parts(offsets):
                words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALPHANUMERIC)
                terms, document, counts = _counted(words.hashes, words.document, b - a)
                ids = batch.column("item_id").take(pa.array(document + a))
                yield pa.RecordBatch.from_arrays([ids, longs(terms), pa.array(counts)], ["item_id", "term", "n"])

    kind = items.schema["item_id"].dataType.simpleString()
    terms = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term long, n long")
    terms = terms.groupBy("item_id", "term").agg(F.sum("n").alias("n"))
    return terms.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "n"))).alias("terms"))


def _blocks(items: DataFrame) -> Iterator[_Block]:
    """Items in blocks of at most BLOCK_TERMS (item, term) pairs; one block at a time is on the driver."""
    held, size = [], 0

    def block() -> _Block:
        terms = np.unique(np.concatenate([t for _, t, _ in held]))
        places = [np.searchsorted(terms, t) for _, t, _ in held]
        return _Block(terms, [i for i, _, _ in held], places, [n for _, _, n in held])

    for row in items.toLocalIterator():
        if held and size + len(row.terms) > BLOCK_TERMS:
            yield block()
            held, size = [], 0
        terms = np.array([t.term for t in row.terms], np.int64).view(np.uint64)
        held.append((row.item_id, terms, np.array([t.n for t in row.terms], np.int64)))
        size += len(row.terms)
    if held:
        yield block()


def search(index: DataFrame, items: DataFrame, k: int = 10, staging: Staging | None = None) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents with a score above 0.

    ``index`` comes from index_documents() and is read twice for each block of items, so it should be a written
    table.  ``items`` has ``item_id`` and ``text``; other columns are not read.  Rows of one item_id, nulls alike, are
    one item with the terms of all of them.  An item without terms (null, empty) or without a document has no rows; so
    has every item over an empty index.  Equal scores go by doc_id, null last, and repeated documents take a rank each.

    A term that df of N documents hold weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); tf occurrences in a document
    of n terms, of L in all, are worth w * (10^9 tf div (1000 tf + 8 (25 + 75 n N div L))) for each time that the item
    has the term.
    """
    spark: SparkSession = index.sparkSession
    staging = staging or Staging(spark)
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    size = index.agg(F.sum(F.size("lengths")).alias("n"), F.sum(total).alias("l")).first()
    kind = items.schema["item_id"].dataType
    found = spark.createDataFrame([], f"item_id {kind.simpleString()}, doc_id long, score long")
    if size.n:
        for i, block in enumerate(_blocks(staging.table(_item_terms(items), "items"))):
            block.documents, block.length = int(size.n), int(size.l)
            df = _frequencies(index, block)
            block.weights = np.floor(1000 * np.log((2 * block.documents + 2) / (2 * df + 1))).astype(np.int64)
            found = found.unionByName(staging.table(_search_block(index, block, k, kind), f"best-{i}"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """search() over an index of ``docs`` that is written for it and removed afterwards."""
    staging = Staging(docs.sparkSession)
    index = staging.table(index_documents(docs), "index", **INDEX_OPTIONS)
    found = search(index, items, k, staging)
    staging.drop("index")
    return found
