"""The trie of the prefixes that conversations share, by a skeleton of splitter paths.

A turn is 16 bytes of the digest of its role and text, a conversation the path
of its turns, and prefixes of paths are the nodes.  Distinct paths are cut into
ranges by sampled splitters.  The splitters and their prefixes are the skeleton,
the only nodes that more than one range can touch; it goes to every task.  A
task walks its range in order with a stack, finishes all other nodes there, and
gives what it saw of skeleton nodes, which one reduction adds up.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.llm.staging import Staging
from gustline.session import literal_table

#: Bytes of a turn in a path.
STEP = 16
#: Turns that a range should hold, and the most ranges there are.
RANGE_TURNS, MOST_RANGES = 1 << 18, 2048
#: Paths sampled for each range, and the turns of them that splitters are made of.
SAMPLES, SPLIT_TURNS = 16, 64
#: Ids of one piece of a list that runs over several tasks, and rows of an output batch.
PIECE_IDS, BATCH_ROWS = 1 << 16, 1 << 13

EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, digests (one string a turn) and sizes (UTF-8 bytes of its text) of each conversation.

    Reads ``conv_id`` (integer), ``turn``, ``role`` and ``text`` alone.  Turns go by ``turn``, null first, equal ones
    by their digest; repeated rows are turns of their own.  A null role or text is empty.  Rows without a conv_id
    belong to no conversation.  Texts stay where they are; 50 bytes a turn move, and a conversation's have to fit a
    row (2 GB).
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.sha2(name.cast("binary"), 256), 1, 2 * STEP)
    row = F.struct("turn", digest.alias("digest"), F.octet_length(text).alias("size"))
    listed = turns.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
    sorted_rows = listed.agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return sorted_rows.select("conv_id", F.col("rows.digest").alias("digests"), F.col("rows.size").alias("sizes"))


def spliced(convs: DataFrame, stride: int, most: int) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % stride, then c's own after its first h.

    h is the unsigned CRC-32 of the decimal c, modulo ``most``.  A conversation that isn't there gives no turns.
    """
    early = lambda name: F.slice(name, 1, most - 1).alias(f"first_{name}")
    firsts = convs.select(F.col("conv_id").alias("base"), early("digests"), early("sizes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % stride).withColumn("h", h).join(firsts, "base", "left")

    def both(name: str, kind: str) -> Column:
        lent = F.slice(F.coalesce(f"first_{name}", F.array().cast(kind)), F.lit(1), F.col("h"))
        return F.concat(lent, F.slice(name, F.col("h") + 1, F.greatest(F.size(name), F.lit(1)))).alias(name)

    return own.select("conv_id", both("digests", "array<string>"), both("sizes", "array<int>"))


def _ends(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Number, least and digest of the ids of each key; of the first and last key, which may go on elsewhere, pieces."""
    rows: list[tuple] = []
    key, piece, open_ended = None, [], True

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 5
        rows.clear()
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "least", "n", "ends_sha256", "piece"]
        )

    def close(whole: bool) -> None:
        if piece:
            text = ",".join(map(str, piece))
            cells = (hashlib.sha256(text.encode()).hexdigest(), None) if whole else (None, text)
            rows.append((key, piece[0], len(piece), *cells))
            piece.clear()

    for batch in batches:
        for new, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if new != key:
                close(whole=not open_ended)
                open_ended, key = key is None, new
            piece.append(conv)
            if len(piece) == most:
                open_ended = True
                close(whole=False)
            if len(rows) >= BATCH_ROWS:
                yield out()
    close(whole=False)
    yield out()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a key in order, as one row."""
    key, sha, n, least, done = None, None, 0, 0, []
    for batch in batches:
        names = ("key", "least", "n", "piece")
        for new, low, size, piece in zip(*(batch.column(c).to_pylist() for c in names)):
            if new != key:
                if key is not None:
                    done.append((key, least, n, sha.hexdigest()))
                key, sha, n, least = new, hashlib.sha256(), 0, low
            else:
                sha.update(b",")
            sha.update(piece.encode())
            n += size
    if key is not None:
        done.append((key, least, n, sha.hexdigest()))
    columns = list(zip(*done)) if done else [[]] * 4
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "least", "n", "ends_sha256"])


def members(paths: DataFrame, staging: Staging, piece_ids: int = PIECE_IDS) -> DataFrame:
    """key, least, n and ends_sha256 of the conversations of each path.

    Ids are sorted over the whole cluster, a key with very many of them over many tasks; what a digest needs in order
    then passes one task in pieces, and nothing is ever held whole.
    """
    ordered = paths.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    kind = "key binary, least long, n long, ends_sha256 string"
    cut = staging.table(ordered.mapInArrow(lambda batches: _ends(batches, piece_ids), f"{kind}, piece string"), "ends")
    pieces = cut.filter("piece is not null").repartition("key").sortWithinPartitions("key", "least")
    return cut.filter("piece is null").drop("piece").unionByName(pieces.drop("ends_sha256").mapInArrow(_joined, kind))


@dataclass
class Skeleton:
    """The trie of the splitters.  Node 0 is the root; a node comes after its parent."""

    splitters: list[bytes] = field(default_factory=list)
    child: dict[tuple[int, bytes], int] = field(default_factory=dict)
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    size: list[int] = field(default_factory=lambda: [0])

    def add(self, path: bytes, sizes: list[int]) -> None:
        self.splitters.append(path)
        at = 0
        for d in range(len(path) // STEP):
            step = (at, path[d * STEP : (d + 1) * STEP])
            if step not in self.child:
                self.child[step] = len(self.parent)
                self.parent.append(at)
                self.depth.append(d + 1)
                self.size.append(sizes[d])
            at = self.child[step]

    def children(self) -> list[int]:
        out = [0] * len(self.parent)
        for p in self.parent[1:]:
            out[p] += 1
        return out

    def sizes_below(self) -> list[int]:
        """Sizes of the skeleton nodes in each node's subtree."""
        out = list(self.size)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out


def skeleton(paths: DataFrame, ranges: int) -> Skeleton:
    """Splitters that cut ``paths`` (distinct: key, path, sizes) into ranges of like numbers of turns.

    A path's chance to be drawn is in proportion to its turns.  The sample is SAMPLES paths a range, of which only the
    first SPLIT_TURNS turns are taken (20 bytes each); paths that part later stay in one range.  A splitter is the shortest prefix that
    sets it apart from the sampled path before it.
    """
    out = Skeleton()
    weight = (F.size("sizes") + 1).cast("long")
    total = paths.agg(F.sum(weight)).first()[0] or 0
    if ranges < 2 or not total:
        return out
    chance = weight * (SAMPLES * ranges / total)
    drawn = paths.filter(F.shiftrightunsigned(F.xxhash64("key"), 11) < chance * float(1 << 53))
    short = drawn.select(F.expr(f"substring(path, 1, {STEP * SPLIT_TURNS})").alias("path"), F.slice("sizes", 1, SPLIT_TURNS).alias("sizes"))
    sample = sorted((bytes(r.path), list(r.sizes)) for r in short.collect())
    step = max(1, len(sample) // ranges)
    for i in range(step, len(sample), step):
        before, (path, sizes) = sample[i - 1][0], sample[i]
        if path != before:
            end = (_shared(before, path) + 1) * STEP
            if not out.splitters or path[:end] != out.splitters[-1]:
                out.add(path[:end], sizes)
    return out


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from the start."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * STEP] == b[: middle * STEP]:
            low = middle
        else:
            high = middle - 1
    return low


class _Node:
    __slots__ = ("skeleton", "size", "n", "least", "children", "leaves", "saved", "ends", "pending")

    def __init__(self, skeleton: int, size: int):
        self.skeleton, self.size = skeleton, size
        self.n, self.least, self.children, self.leaves, self.saved, self.ends, self.pending = 0, None, 0, 0, 0, None, []


class _Walk:
    """The stack of one range; finished rows gather in ``rows``."""

    def __init__(self, trie: Skeleton, grown: list[int]):
        self.trie, self.grown, self.rows = trie, grown, []
        self.path, self.stack = b"", [_Node(0, 0)]

    def add(self, path: bytes, sizes: list[int], n: int, least: int, ends: str) -> None:
        self.back(_shared(self.path, path))
        for d in range(len(self.stack) - 1, len(path) // STEP):
            top = self.stack[-1]
            known = self.trie.child.get((top.skeleton, path[d * STEP : (d + 1) * STEP]), -1) if top.skeleton >= 0 else -1
            if known < 0:
                top.children += 1
            self.stack.append(_Node(known, sizes[d]))
        self.path, top = path, self.stack[-1]
        top.n, top.ends = top.n + n, ends
        top.least = least if top.least is None else min(top.least, least)

    def back(self, depth: int) -> None:
        while len(self.stack) > depth + 1:
            self.close()

    def close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        if node.skeleton < 0:
            leaves = node.leaves or 1
            saved = node.saved + (node.n - 1) * node.size
            own = (node.least, depth, node.n, node.children, leaves, saved, node.ends or EMPTY)
            above = self.stack[-1]
            # a child's row waits until its parent's least member is known
            self.rows += [(-1, -1, node.least, *row) for row in node.pending]
            if above.skeleton < 0:
                above.pending.append(own)
            else:
                self.rows.append((-1, above.skeleton, None, *own))
        else:
            alone = not self.grown[node.skeleton] and not node.children
            leaves = node.leaves + alone
            saved = node.saved + node.n * node.size
            self.rows.append((node.skeleton, -1, None, node.least, depth, node.n, node.children, leaves, saved, node.ends))
        if self.stack:
            above = self.stack[-1]
            above.n += node.n
            above.least = node.least if above.least is None else min(above.least, node.least)
            above.leaves += leaves
            above.saved += saved


_OUT = pa.schema(
    [
        ("skeleton", pa.int32()),
        ("above", pa.int32()),
        ("parent_conv_id", pa.int64()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()),
    ]
)
_SCHEMA = (
    "skeleton int, above int, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)


def _walk(paths: DataFrame, trie: Skeleton) -> DataFrame:
    """Rows of finished nodes, and of what each range saw of skeleton nodes."""
    sent = paths.sparkSession.sparkContext.broadcast(trie)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = sent.value.splitters
        for batch in batches:
            place = [bisect.bisect_right(cuts, p) for p in batch.column("path").to_pylist()]
            yield batch.append_column("range", pa.array(place, pa.int32()))

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(rows), BATCH_ROWS):
            columns = zip(*rows[low : low + BATCH_ROWS])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)
        rows.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value
        grown, walk, current = trie.children(), None, None
        for batch in batches:
            names = ("range", "path", "sizes", "n", "least", "ends_sha256")
            for place, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                if place != current:
                    if walk is not None:
                        walk.back(-1)
                        yield from out(walk.rows)
                    walk, current = _Walk(trie, grown), place
                walk.add(*row)
            if walk is not None and len(walk.rows) >= BATCH_ROWS:
                yield from out(walk.rows)
        if walk is not None:
            walk.back(-1)
            yield from out(walk.rows)

    held = paths.select("path", "sizes", "n", "least", "ends_sha256")
    schema = "path binary, sizes array<int>, n long, least long, ends_sha256 string"
    dealt = held.mapInArrow(deal, f"{schema}, range int").repartitionById(len(trie.splitters) + 1, F.col("range"))
    return dealt.sortWithinPartitions("range", "path").mapInArrow(run, _SCHEMA)


def build(convs: DataFrame, staging: Staging | None = None) -> DataFrame:
    """The nodes of the trie of ``convs``: conv_id (distinct), digests and sizes, as sequences() has them.

    One row for each distinct sequence of first turns: conv_id (its smallest member), depth, parent_conv_id (null at
    the root), n_convs (members), n_children, n_leaves (childless nodes in its subtree), saved_tokens (over its
    subtree, (n_convs - 1) times the bytes of a node's last text) and ends_sha256 (of the ids of members that end
    there, ascending, joined by commas).  A conversation without turns is a member of the root and ends there; no
    conversations give no nodes.

    Equal conversations are one path, however many there are.  A range is sorted and walked as a stream; held are the
    nodes on the way to the path at hand and their finished children.
    """
    spark = convs.sparkSession
    staging = staging or Staging(spark)
    path = F.unhex(F.array_join("digests", ""))
    key = F.unhex(F.substring(F.sha2(F.array_join("digests", "").cast("binary"), 256), 1, 2 * STEP))
    named = staging.table(convs.select("conv_id", key.alias("key"), path.alias("path"), "sizes"), "named")
    once = named.groupBy("key").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    paths = staging.table(once.join(members(named, staging), "key"), "paths")
    turns = paths.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // RANGE_TURNS))
    trie = skeleton(paths, min(MOST_RANGES, wide))
    found = staging.table(_walk(paths, trie), "walked")
    parts = found.filter("skeleton >= 0").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"),
    )
    fixed = list(zip(range(len(trie.parent)), trie.parent, trie.depth, trie.children(), trie.sizes_below()))
    known = literal_table(spark, fixed, "skeleton int, above int, depth long, grown long, below long")
    summed = parts.join(F.broadcast(known), "skeleton").select(
        "skeleton",
        "above",
        "conv_id",
        "depth",
        "n_convs",
        (F.col("n_children") + F.col("grown")).alias("n_children"),
        "n_leaves",
        (F.col("saved_tokens") - F.col("below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    summed = staging.table(summed, "skeleton")
    ids = F.broadcast(summed.select(F.col("skeleton").alias("above"), F.col("conv_id").alias("above_conv_id")))
    hung = found.filter("skeleton < 0").drop("skeleton").join(ids, "above", "left")
    hung = hung.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_conv_id"))
    ribs = summed.join(ids, "above", "left").withColumn("parent_conv_id", F.col("above_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return hung.select(columns).unionByName(ribs.select(columns))
