"""Search, trie and shards against brute force, with the cases that their docstrings define."""

import collections
import functools
import hashlib
import math
import pathlib
import random
import re
import zlib

import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from gustline.llm import lexical_search, prefix_trie, queries, sharding
from gustline.llm.staging import Staging

CLASHING = ("docs", "terms", "at", "n", "rank", "score", "key", "range", "path", "size", "shard", "_range", "h", "base")


def clashing(df):
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    return df


def sentence(r, n, words=60):
    return " ".join(f"w{min(r.randrange(words), r.randrange(words))}" for _ in range(n))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    held = [(d, collections.Counter(terms_of(t)), len(terms_of(t))) for d, t in docs]
    held = [x for x in held if x[2]]
    n_docs, length = len(held), sum(x[2] for x in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    wanted = collections.defaultdict(list)
    for i, t in items:
        wanted[i] += terms_of(t)
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c, n in held:
            m = 25 + (75 * n * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms
                if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    docs = [(i, sentence(r, r.randint(1, 80))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(120)]  # a group of copies: ties far beyond ten
    docs += [(None, docs[7][1]), (None, None), (2000, ""), (2001, " .,;\n"), (2002, None), (3, docs[3][1]), (3, "W1 w1 É été W59")]
    docs += [(2003, sentence(r, 30000)), (2004, "Été\x00w1|w2_w3"), (2005, "w59")]
    items = [(i, sentence(r, r.randint(1, 25))) for i in range(30)]
    items += [(40, docs[7][1]), (41, None), (42, ""), (43, "nowhere at all"), (44, "W1 w1 w1"), (None, "w59 été"), (45, "w2"), (45, "w3")]
    return docs, items


def test_search_is_whole(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 90)
    docs_df = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(9))
    items_df = clashing(spark.createDataFrame(items, "item_id long, text string"))
    index = Staging(spark).table(lexical_search.index_documents(docs_df, shard_docs=64), "index")
    assert index.count() > 5
    for found, k in ((lexical_search.search_documents(docs_df, items_df), 10), (lexical_search.search(index, items_df, 3), 3)):
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in found.collect()), key=str) == brute_search(docs, items, k)


def test_search_skips_long_lists(monkeypatch):
    """Documents that only lists of low bounds bring are never summed, and the best are the same."""
    r = random.Random(2)
    np = lexical_search.np
    n, best = 4096, lexical_search._Best(5)
    lists = []
    for size, most in ((4000, 3), (3000, 5), (40, 90), (30, 70)):
        at = np.array(sorted(r.sample(range(n), size)))
        worth = np.array([r.randint(1, most) for _ in at[1:]] + [most])
        lists.append((at, worth, int(worth.max())))
    shard = object.__new__(lexical_search._Shard)
    shard.docs, shard.absent = np.arange(n), np.zeros(n, bool)
    kept = shard.accumulate(lists)
    assert len(kept) == 3 and kept[-1][2] >= 90  # the two short lists are one iterator
    seen = []
    monkeypatch.setattr(best, "add", lambda s, a, d: (seen.append(len(d)), lexical_search._Best.add(best, s, a, d)))
    shard.rank(kept, best, stride=256)
    sums = np.zeros(n, np.int64)
    for at, worth, _ in lists:
        sums[at] += worth
    order = np.lexsort((np.arange(n), -sums))[:5]
    assert best.docs.tolist() == order.tolist() and best.scores.tolist() == sums[order].tolist()
    assert sum(seen) < n / 8


def test_shards_are_read_apart(spark, corpus, monkeypatch):
    """A row group is decoded whole, so each holds one shard, however many a task writes."""
    docs, items = corpus
    kept = []
    monkeypatch.setattr(Staging, "drop", lambda self, name="": kept.append(f"{self.root}/{name}"))
    small = functools.partial(lexical_search.index_documents, shard_docs=16)
    monkeypatch.setattr(lexical_search, "index_documents", small)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        docs_df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
        found = lexical_search.search_documents(docs_df, spark.createDataFrame(items, "item_id long, text string"), 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = pathlib.Path(kept[0].removeprefix("file:")).glob("*.parquet")
    written = [parquet.ParquetFile(f).metadata for f in files]
    assert max(m.num_rows for m in written) > 20
    assert all(m.num_row_groups == m.num_rows for m in written)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_search(docs, items, 3)


def test_search_of_nothing(spark, corpus):
    docs, items = corpus
    none_d, none_i = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    some_d, some_i = spark.createDataFrame(docs[:5], none_d.schema), spark.createDataFrame(items[:3], none_i.schema)
    for d, i in ((none_d, some_i), (some_d, none_i), (spark.createDataFrame([(1, None)], none_d.schema), some_i)):
        assert lexical_search.search_documents(d, i).collect() == []


def digest_of(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def brute_trie(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    nodes, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    kids = collections.defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = own + sum(saved[k] for k in kids[p])
    return sorted(
        (
            (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], digest_of(ends[p]))
            for p, m in nodes.items()
        ),
        key=str,
    )


def turns_of(rows):
    convs = collections.defaultdict(list)
    name = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()[:32]
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, name(role, text), role, text))
    return {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}


@pytest.fixture(scope="module")
def talk():
    r, rows = random.Random(9), []
    for c in range(260):
        shared = [("user", "hello"), ("assistant", f"path {c % 3}"), ("user", "é" * (c % 7))][: r.randint(0, 3)]
        turns = shared + [(r.choice(["user", "assistant"]), f"t{r.randrange(5)}") for _ in range(r.randint(0, 6))]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns or [("user", "only")])]
    rows += [(500 + c, i, "user", f"same {i}") for c in range(150) for i in range(4)]  # a large group of copies
    rows += [(900, i, "user", f"deep {i}") for i in range(300)] + [(901, i, "user", f"deep {min(i, 250)}") for i in range(290)]
    rows += [(910, None, None, "n"), (910, 0, "a", None), (910, 0, "a", None), (911, 3, "a", "x"), (911, 3, "b", "x"), (None, 1, "a", "b")]
    rows += [(-7, 0, "user", "hello"), (-7, 1, "assistant", "path 1")]
    return rows


@pytest.mark.parametrize("range_turns", [1 << 18, 60, 5])
def test_trie_is_whole(spark, talk, monkeypatch, range_turns):
    monkeypatch.setattr(prefix_trie, "RANGE_TURNS", range_turns)
    monkeypatch.setattr(prefix_trie, "MOST_RANGES", 80)
    df = clashing(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").repartition(4))
    found = prefix_trie.build(prefix_trie.sequences(df))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found.columns == columns
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_trie(turns_of(talk))


def test_members_in_pieces(spark):
    """Ids of a key that runs over many tasks pass in pieces and give the digest of the whole list."""
    rows = [(b"a" if i % 3 else bytes([i % 50]), i) for i in range(2000)] + [(b"z", 5000)]
    paths = spark.createDataFrame(rows, "key binary, conv_id long").repartition(7)
    want = collections.defaultdict(list)
    for k, i in rows:
        want[k].append(i)
    for most in (1, 7, 1 << 16):
        found = prefix_trie.members(paths, Staging(spark), most).collect()
        assert {bytes(r.key): (r.least, r.n, r.ends_sha256) for r in found} == {
            k: (min(v), len(v), digest_of(v)) for k, v in want.items()
        }
        assert len(found) == len(want)


def test_trie_of_rebuilt_conversations(spark, talk, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RANGE_TURNS", 40)
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    found = prefix_trie.build(prefix_trie.spliced(prefix_trie.sequences(df), stride=5, most=9))
    own = turns_of(talk)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - math.fmod(c, 5), [])[:h] + turns[h:]
    assert any(not t for t in rebuilt.values())
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_trie(rebuilt)


def test_skeleton_cuts_evenly(spark, monkeypatch):
    """Splitters part what shares a long first part, and no range has much more than its share."""
    r = random.Random(4)
    rows = [(c, i, "user", "same" if i < 5 else f"t{r.randrange(9)}") for c in range(900) for i in range(5 + r.randint(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    named = prefix_trie.sequences(df).select(
        F.unhex(F.array_join("digests", "")).alias("path"), F.sha2(F.array_join("digests", ""), 256).alias("key"), "sizes"
    )
    paths = Staging(spark).table(named.dropDuplicates(["key"]), "paths")
    trie = prefix_trie.skeleton(paths, 12)
    assert len(trie.splitters) >= 9 and trie.splitters == sorted(set(trie.splitters))
    assert min(len(s) for s in trie.splitters) > 5 * prefix_trie.STEP
    cuts = [prefix_trie.bisect.bisect_right(trie.splitters, bytes(p.path)) for p in paths.collect()]
    assert max(collections.Counter(cuts).values()) < 3 * len(cuts) / 12


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.build(prefix_trie.sequences(none)).collect() == []
    lost = spark.createDataFrame([(None, 1, "a", "b")], none.schema)
    assert prefix_trie.build(prefix_trie.sequences(lost)).collect() == []
    empty = spark.createDataFrame([(7, [], [])], "conv_id long, digests array<string>, sizes array<int>")
    assert [tuple(r) for r in prefix_trie.build(empty).collect()] == [(7, 0, None, 1, 0, 1, 0, digest_of([7]))]


def test_shards_are_even(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, sentence(r, r.randint(1, 60))) for i in range(1500)] + [(5000 + i, "a third of all " * 30) for i in range(900)]
    rows += [(77, "one row many times " * 9)] * 500 + [(None, None), (None, ""), (None, None), (8000, "é" * 2500), (8001, sentence(r, 4000))]
    r.shuffle(rows)
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    found = sharding.assign(df).collect()
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert collections.Counter((x.doc_id, x.size, x.text_crc32) for x in found) == want
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for x in found:
        sizes[x.shard] += x.size
        slots[x.shard].append(x.slot)
    assert sorted(sizes) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 16
    assert max(abs(s - mean) for s in sizes.values()) < 0.05 * mean
    # equal texts lie in as few shards as their bytes need
    assert len({x.shard for x in found if 5000 <= (x.doc_id or 0) < 6000}) <= 900 * 451 / mean + 2


def test_overfull_ranges_are_cut(spark, monkeypatch):
    """A sample that misses leaves ranges too full; they are cut until all are within their share."""
    monkeypatch.setattr(sharding, "SAMPLES", 1)
    rows = [(i, "x" * (i % 50)) for i in range(4000)]
    records = Staging(spark).table(sharding._records(spark.createDataFrame(rows, "doc_id long, text string")), "records")
    total = records.agg(F.sum("size")).first()[0]
    monkeypatch.setattr(sharding, "RANGES", 4)
    plan = sharding.plan_shards(records, 4)
    assert len(plan.splitters) + 1 >= 8
    totals = sharding._counted(records, plan.splitters)
    assert all(size - most <= sharding.FULL * total / 16 for size, n, most in totals)


def test_shards_of_nothing_and_one(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign(none).collect() == []
    one = sharding.assign(spark.createDataFrame([(1, "abc")], none.schema)).collect()
    assert [(x.doc_id, x.size, x.slot) for x in one] == [(1, 4, 0)] and 0 <= one[0].shard < 16


def test_shards_written(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, sentence(r, r.randint(1, 20))) for i in range(600)] + [(None, None), (3, "w1"), (3, "w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("k")).withColumn("size", F.lit(1))
    sharding.write_shards(df, str(tmp_path / "out"), shards=4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*df.columns, "shard"}
    assert collections.Counter((x.doc_id, x.text) for x in back.collect()) == collections.Counter(rows)
    assert sorted(x.shard for x in back.select("shard").distinct().collect()) == [0, 1, 2, 3]


def test_sharding_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(50)], "doc_id long, text string")
    plan = sharding.assign(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_queries_are_registered():
    assert {"op11_hybrid_search", "op12_prefix_trie"} <= set(queries.ORACLES) and "op13_sampled_splitters" in queries.QUERIES
