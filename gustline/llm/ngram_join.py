"""Exact Jaccard self-join on word shingles with adaptive multi-match prefixes.

Two sets that meet the threshold share all but a known number of shingles, so
with shingles in one global order they share at least k of their first
n - t + k, for any k.  Each text picks its own k: a longer prefix costs more
index rows but asks for more shared ones, and pays where its shingles are
common.  Of two texts, the smaller k holds.

The order is by load of a shingle's slot in a table of fixed size, counted over
all texts, then by hash: passages that many texts share come last.  Texts with
equal sets are one class throughout.  Classes that share prefix shingles are
brought together in families and compared there, block against block, so that
neither the pairs nor the shared shingles of a large group are ever rows.  What
may still link two families is verified pair by pair where few classes share a
shingle, and again block against block where many do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.components import components
from gustline.llm.rows import keep_rows, text_key, text_keys
from gustline.llm.staging import Staging
from gustline.llm.words import SPACED, longs, parts, set_digests, shingle_sets, text_bytes, words_of
from gustline.session import broadcast_if_small

#: Slots of the load table (one byte each where it is sent), and slots in one row of it.
SLOT_BITS, ROW_BITS = 22, 12
#: How many shared prefix shingles a text may ask for, and of how many texts each is expected to be by chance.
MATCHES, CHANCE = (1, 2, 4, 8, 16, 32, 64), 0.05
#: Classes and shingles of a block; a task holds two blocks.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 1 << 19
#: Most classes of a shingle whose pairs are counted one by one; those of a commoner one are compared in blocks.
PAIRED_CLASSES = 64
#: Bits of the field of texts whose sets are needed; more only saves rows.
FIELD_BITS = 25
_TOKEN_BITS = 56


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents with their sets, the sets' offsets, and hashes of the texts."""
    data, offsets = text_bytes(batch.column("text"))
    for a, b in parts(offsets):
        own = offsets[a : b + 1] - offsets[a]
        piece = data[offsets[a] : offsets[b]]
        value, ends = shingle_sets(words_of(piece, own, SPACED), size)
        yield a, b, value, ends, text_keys(piece, own)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """Rows of two kinds: doc_id, n, class and key of each document; row and counts of the load table of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            for a, b, value, ends, keys in _sets(batch, size):
                slots, counts = np.unique((value >> np.uint64(64 - SLOT_BITS)).astype(np.uint32), return_counts=True)
                load[slots] += counts.astype(np.uint32)
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, n),
                        pa.array(np.diff(ends)),
                        longs(set_digests(value, ends)),
                        longs(keys),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()),
                    ],
                    ["doc_id", "n", "class", "key", "row", "counts"],
                )
        rows = load.reshape(-1, 1 << ROW_BITS)
        full = np.flatnonzero(rows.any(axis=1))
        for some in np.array_split(full, max(1, len(full) // 256)):
            none = [pa.nulls(len(some), pa.int64())] * 4
            counts = pa.array([rows[i].tobytes() for i in some], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*none, pa.array(some.astype(np.int32)), counts], ["doc_id", "n", "class", "key", "row", "counts"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, class long, key long, row int, counts binary"
    )


def load_levels(sketched: DataFrame) -> np.ndarray:
    """One byte for each slot: twice the binary logarithm of its load.  Its size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, counts in zip(batch.column("row").to_pylist(), batch.column("counts")):
                found = np.frombuffer(counts.as_buffer(), np.uint32)
                if row in sums:
                    sums[row] += found
                else:
                    sums[row] = found.astype(np.uint64)
        levels = [np.floor(2 * np.log2(x + 1.0)).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["row", "levels"]
        )

    rows = sketched.filter("row is not null").select("row", "counts").repartition("row")
    table = np.zeros((1 << SLOT_BITS - ROW_BITS, 1 << ROW_BITS), np.uint8)
    for r in rows.mapInArrow(run, "row int, levels binary").collect():
        table[r.row] = np.frombuffer(bytes(r.levels), np.uint8)
    return table.reshape(-1)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n must share with any set that it links to."""
    return -(-percent * n // 100)


def prefixes(docs: DataFrame, size: int, percent: int, levels, mean: float) -> DataFrame:
    """Rows of two kinds, each class once per task: ref, class, n and need of the class; token and ref of its prefix.

    ``ref`` is a number within the task, so that index rows, of which there are most, stay short; ``need`` is the k
    that the text picked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        base = TaskContext.get().partitionId() << 32
        # texts beyond what chance puts into a slot of each level
        surplus = np.maximum(0.0, np.exp2(np.arange(256) / 2.0) - 4 * mean - 4)
        seen: set[int] = set()
        for batch in batches:
            for _, _, value, ends, _ in _sets(batch, size):
                digests = set_digests(value, ends)
                sizes = np.diff(ends)
                fresh = np.zeros(len(sizes), bool)
                for i, d in enumerate(digests.tolist()):
                    if d not in seen and sizes[i]:
                        seen.add(d)
                        fresh[i] = True
                level = table[(value >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64)
                token = (level << np.uint64(_TOKEN_BITS)) | (value >> np.uint64(64 - _TOKEN_BITS))
                for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    token[start:end].sort()
                cost = np.zeros(len(token) + 1)
                np.cumsum(surplus[(token >> np.uint64(_TOKEN_BITS)).astype(np.int64)], out=cost[1:])
                n, start = sizes[fresh], ends[:-1][fresh]
                t = least_overlap(n, percent)
                k = np.array(MATCHES)
                reach = np.minimum(n[:, None] - t[:, None] + k, n[:, None])
                scan = cost[start[:, None] + reach] - cost[start][:, None] + CHANCE * reach
                # index rows, texts met there, and candidates (at most those / k) verified shingle by shingle
                total = reach + scan * (1 + n[:, None] / (16.0 * k))
                total[k[None, :] > np.maximum(t, 1)[:, None]] = np.inf
                need = k[total.argmin(axis=1)]
                take = np.minimum(n - t + need, n)
                first = np.repeat(start, take)
                nth = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                ref = base + np.arange(len(n))
                base += len(n)
                names, rows = ["token", "ref", "class", "n", "need"], int(take.sum())
                none, gap = [pa.nulls(len(n), pa.int64())], pa.nulls(rows, pa.int32())
                about = [pa.array(ref), longs(digests[fresh]), pa.array(n.astype(np.int32)), pa.array(need.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(none + about, names)
                tokens, owner = longs(token[first + nth]), pa.array(np.repeat(ref, take))
                yield pa.RecordBatch.from_arrays([tokens, owner, pa.nulls(rows, pa.int64()), gap, gap], names)

    return docs.select(F.lit(None).cast("long").alias("doc_id"), "text").mapInArrow(
        run, "token long, ref long, class long, n int, need int"
    )


def viable(met: DataFrame) -> DataFrame:
    """The classes that may have a candidate.  met: class, need and low (the least need of a shingle's texts).

    Shingles shared with a text that asks for v have a low of at most v, so there must be enough of those for some v.
    """
    upto = {v: F.sum((F.col("low") <= v).cast("int")).alias(f"upto{v}") for v in MATCHES}
    enough = " or ".join(f"upto{v} >= least(need, {v})" for v in MATCHES)
    return met.groupBy("class").agg(F.first("need").alias("need"), *upto.values()).filter(enough).select("class")


def bit_field(df: DataFrame, column: str):
    """A field of 2 ** FIELD_BITS bits, those set that the column's values name; its size is fixed."""
    slot = F.col(column).bitwiseAND(F.lit((1 << FIELD_BITS) - 1))
    words = (
        df.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(`{column}` & 63L as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    field = np.zeros(1 << (FIELD_BITS - 6), np.int64)
    field[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return df.sparkSession.sparkContext.broadcast(field.view(np.uint64))


#: Bytes of a shingle's hash in a set that moves: two sets of a thousand meet by chance once in 280 million pairs.
SET_BYTES = 6


def packed(value: np.ndarray) -> bytes:
    """The upper SET_BYTES of each hash, end to end."""
    return value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - SET_BYTES :].tobytes()


def unpacked(given: bytes) -> np.ndarray:
    whole = np.zeros((len(given) // SET_BYTES, 8), np.uint8)
    whole[:, 8 - SET_BYTES :] = np.frombuffer(given, np.uint8).reshape(-1, SET_BYTES)
    return whole.view("<u8").ravel()


def class_sets(docs: DataFrame, size: int, field) -> DataFrame:
    """class and set (hashes, end to end) of the texts whose key is in the field, each class once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = field.value
        seen: set[int] = set()
        given: set[int] = set()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in parts(offsets):
                own = offsets[a : b + 1] - offsets[a]
                piece = data[offsets[a] : offsets[b]]
                keys = text_keys(piece, own)
                slot = (keys & np.uint64((1 << FIELD_BITS) - 1)).astype(np.int64)
                wanted = (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
                chosen = []
                for i in np.flatnonzero(wanted).tolist():
                    if int(keys[i]) not in seen:
                        seen.add(int(keys[i]))
                        chosen.append(i)
                if not chosen:
                    continue
                lengths = np.diff(own)[chosen]
                joined = np.concatenate([piece[own[i] : own[i + 1]] for i in chosen])
                value, ends = shingle_sets(words_of(joined, np.concatenate([[0], np.cumsum(lengths)]), SPACED), size)
                digests = set_digests(value, ends)
                fresh = []  # unlike texts may have one set
                for i, d in enumerate(digests.tolist()):
                    if d not in given:
                        given.add(d)
                        fresh.append(i)
                sets = [packed(value[ends[i] : ends[i + 1]]) for i in fresh]
                yield pa.RecordBatch.from_arrays([longs(digests[fresh]), pa.array(sets, pa.binary())], ["class", "set"])

    return docs.select("text").mapInArrow(run, "class long, set binary")


def overlaps(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sizes of the pairwise intersections of sets that lie end to end in ``value``."""
    g = len(sizes)
    owner = np.repeat(np.arange(g), sizes)
    _, token, counts = np.unique(value, return_inverse=True, return_counts=True)
    out = np.zeros((g, g), np.float32)
    shared = counts[token] > 1
    owner, token = owner[shared], token[shared]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    df = counts[token]
    heavy = df > max(8, g // 16)
    if heavy.any():
        rows, cols = owner[heavy], np.unique(token[heavy], return_inverse=True)[1]
        for low in range(0, int(cols.max()) + 1, 2048):
            here = (cols >= low) & (cols < low + 2048)
            block = np.zeros((g, 2048), np.float32)
            block[rows[here], cols[here] - low] = 1
            out += block @ block.T
    for d in np.unique(df[~heavy]):
        held = owner[~heavy & (df == d)].reshape(-1, d)
        i, j = np.triu_indices(d, 1)
        for some in np.array_split(held, max(1, len(held) * len(i) // (1 << 20))):
            cell = some[:, i].ravel() * g + some[:, j].ravel()
            out += np.bincount(cell, minlength=g * g).reshape(g, g).astype(np.float32)
    return np.maximum(out, out.T)


def spanning_links(linked: np.ndarray) -> list[tuple[int, int]]:
    """A star of links for each connected part of a symmetric matrix."""
    left = np.ones(len(linked), bool)
    links = []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            found = np.flatnonzero(linked[at] & left)
            left[found] = False
            links += [(root, int(x)) for x in found]
            todo += found.tolist()
    return links


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        classes, block = table.column("class").to_numpy(), table.column("block").to_numpy()
        sets = [unpacked(x.as_buffer()) for x in table.column("set").combine_chunks()]
        sizes = np.array([len(s) for s in sets])
        both = overlaps(np.concatenate(sets), sizes).astype(np.int64)
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        if table.column("i")[0] != table.column("j")[0]:
            linked &= block[:, None] != block[None, :]
        np.fill_diagonal(linked, False)
        links = np.array(spanning_links(linked), np.int64).reshape(-1, 2)
        return pa.table({"a": classes[links[:, 0]], "b": classes[links[:, 1]]})

    return run


def family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b that connect what is linked within a family.  members: class, family, n."""
    sizes = members.groupBy("family").agg(F.count("*").alias("g"), F.sum("n").alias("total")).filter("g > 1")
    blocks = F.greatest(F.ceil(F.col("g") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = (
        members.join(sizes.select("family", blocks.alias("blocks")), "family")
        .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .join(sets.dropDuplicates(["class"]), "class")  # a class may come from several tasks
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = placed.select("family", "class", "block", "set", other).select(
        "family",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block",
        "class",
        "set",
    )
    return tasks.groupBy("family", "i", "j").applyInArrow(_compare(percent), "a long, b long")


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"]
            )

    return run


def cross_links(shared: DataFrame, marks: DataFrame, sets: DataFrame, percent: int, staging: Staging) -> DataFrame:
    """Links between classes of different families that are not connected yet.  marks: class, family, label.

    Rows are at most PAIRED_CLASSES times those of ``shared``; what a commoner shingle brings together is compared in
    blocks as a family is.
    """
    rows = shared.select("token", "class", "n", "need", "low").distinct().join(marks, "class")
    mixed = (
        rows.groupBy("token")
        .agg(
            F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("family").alias("f0"), F.max("family").alias("f1")
        )
        .filter("l0 != l1 and f0 != f1")
        .select("token")
    )
    # only these shingles can still link, so a class needs enough of them
    rows = staging.table(rows.join(mixed, "token"), "mixed")
    rows = staging.table(rows.join(viable(rows), "class", "left_semi"), "open")
    # many shingles are shared by the same classes, which are one group then
    who = [F.bit_xor(F.xxhash64("class", F.lit(seed))).alias(f"who{seed}") for seed in (1, 2)]
    groups = rows.groupBy("token").agg(F.count("*").alias("g"), *who).filter(F.col("g") > PAIRED_CLASSES)
    groups = staging.table(groups, "groups")
    one = groups.groupBy("g", "who1", "who2").agg(F.min("token").alias("token")).select("token")
    grouped = rows.join(one, "token").select("class", F.col("token").alias("family"), "n")
    together = staging.table(family_links(grouped, sets, percent), "together")
    # a pair that shares such a shingle has been compared, whatever else it shares
    rows = rows.join(groups.select("token"), "token", "left_anti")
    a = rows.select("token", *[F.col(c).alias(f"{c}_a") for c in ("class", "n", "need", "family", "label")])
    b = rows.select("token", *[F.col(c).alias(f"{c}_b") for c in ("class", "n", "need", "family", "label")])
    open_pair = (
        (F.col("class_a") < F.col("class_b"))
        & (F.col("family_a") != F.col("family_b"))
        & (F.col("label_a") != F.col("label_b"))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    )
    pairs = (
        a.join(b, "token")
        .filter(open_pair)
        .groupBy(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
        .agg(F.count("*").alias("both"), F.first(F.least("need_a", "need_b")).alias("need"))
        .filter("both >= need")
        .select("a", "b")
    )
    pairs = staging.table(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = sets.join(broadcast_if_small(ends), "class", "left_semi").dropDuplicates(["class"])
    first = pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a")
    second = first.join(sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
    verified = second.select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long")
    return verified.unionByName(together)


def link_documents(docs: DataFrame, size: int = 5, percent: int = 80, staging: Staging | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, key (a hash of the text) and component (null without a set) of every row.

    Reads ``doc_id`` and ``text`` only; other columns may have any name.  A text's set is its distinct shingles of
    ``size`` words between blanks, tabs and line ends, A-Z as small letters; a text of fewer words is one shingle.  Two
    texts link when 100 * intersection >= ``percent`` * union, and ``component_id`` is the smallest doc_id that links
    reach.  A null or empty text, or one without words, has no set, links with nothing and is its own component.
    Null doc_ids link like others, but name no component: it is null only where a component has no other.  Repeated rows
    are reported each.  An empty table gives no rows.

    A group of copies is one class, however large; a group of near copies is compared in blocks of bounded size, and only
    a star of links for each part that is connected leaves a task.
    """
    spark = docs.sparkSession
    staging = staging or Staging(spark)
    sketched = staging.table(sketch(docs, size), "sketch")
    rows = staging.table(
        sketched.filter("row is null").select("doc_id", F.col("n").alias("n_shingles"), "class", "key"), "rows"
    )
    levels = load_levels(sketched)
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    sent = spark.sparkContext.broadcast(levels)
    index = staging.table(prefixes(docs, size, percent, sent, total / (1 << SLOT_BITS)), "index")
    staging.drop("sketch")
    refs = index.filter("token is null").select("ref", "class", "n", "need")
    tokens = index.filter("token is not null").select("token", "ref")
    # most prefix shingles are one text's own; what is left of the others is little
    common = tokens.groupBy("token").agg(F.min("ref").alias("low"), F.max("ref").alias("high")).filter("low != high")
    named = staging.table(tokens.join(common.select("token"), "token").join(refs, "ref").drop("ref").distinct(), "named-tokens")
    hubs = named.groupBy("token").agg(
        F.min("class").alias("hub"), F.max("class").alias("top"), F.min("need").alias("low")
    )
    met = staging.table(named.join(hubs.filter("hub != top").drop("top"), "token"), "met")
    staging.drop("index")
    staging.drop("named-tokens")
    shared = staging.table(met.join(viable(met), "class", "left_semi"), "shared")
    staging.drop("met")

    votes = shared.groupBy("class", "hub").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    chosen = votes.groupBy("class").agg(
        F.max("c").alias("most"), F.collect_list(F.struct("c", "hub")).alias("votes"), F.first("n").alias("n")
    )
    family = F.array_min(F.transform(F.filter("votes", lambda v: v["c"] * 2 >= F.col("most")), lambda v: v["hub"]))
    members = staging.table(chosen.select("class", family.alias("family"), "n"), "members")
    # one text stands for its class, so that what differs in blanks or capitals alone gives no further sets
    keys = rows.join(members.select("class"), "class", "left_semi").groupBy("class").agg(F.min("key").alias("key"))
    sets = staging.table(class_sets(docs, size, bit_field(keys, "key")), "sets")
    near = staging.table(family_links(members, sets, percent), "near")
    labels = staging.table(components(near, staging, "near-links"), "labels")
    marks = members.join(labels.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "family", F.coalesce("component", "class").alias("label")
    )
    far = staging.table(cross_links(shared, staging.table(marks, "marks"), sets, percent, staging), "far")
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(far)
    parts_ = staging.table(components(known, staging, "all-links"), "components")
    for name in ("shared", "sets", "marks"):
        staging.drop(name)

    classes = rows.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    classes = classes.join(parts_.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "least", F.coalesce("component", "class").alias("component")
    )
    classes = staging.table(classes, "classes")
    ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = staging.table(classes.join(ids, "component").select("class", "component", "component_id"), "named")
    return rows.join(named, "class", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "key",
        "component",
    )


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all its columns; rows without a set all stay.

    Where a component has no doc_id but nulls, or has its smallest twice, the row of the smallest text hash stays.
    """
    found = link_documents(docs, size, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")
    one = found.filter("n_shingles > 0").groupBy("component").agg(first).select("first.doc_id", "first.key")
    stay = found.filter("n_shingles = 0").select("doc_id", "key").union(one)
    return keep_rows(docs, stay, text_key())
