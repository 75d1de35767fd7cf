"""Operators over whole tables and the pipeline, against brute force, with the cases that their docstrings define."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gustline.llm import chunk_dedup, decontaminate, ngram_join, packing
from gustline.llm.components import components
from gustline.llm.staging import Staging

CLASHING = ("_digest", "key", "class", "n", "_own0", "recipe", "tie", "kept", "token", "id", "marks", "row", "cluster_", "need")


def documents(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASHING if clash else ():
        df = df.withColumn(name, F.lit("x"))
    return df


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def text_of(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n))


def changed(text, seed, words):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(words):
        w[r.randrange(len(w))] = "zz" + str(r.random())
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    base = text_of(1, 300)
    passage = text_of(2, 60)
    rows = [(i, base) for i in range(40)] + [(100 + i, changed(base, i, i % 14)) for i in range(60)]
    rows += [(200 + i, text_of(500 + i, 90) + " " + passage + " " + text_of(900 + i, 80)) for i in range(30)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one two"), (304, "One  two"), (305, "one"), (None, base), (None, "lone row")]
    rows += [(306, text_of(7, 20000)), (307, changed(text_of(7, 20000), 3, 60)), (5, base), (5, base), (303, "other text"), (308, None)]
    rows += [(400 + i, text_of(40 + i // 2, 4 + i)) for i in range(20)]
    return rows


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    ids = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((d, len(sets[i]), ids[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("size, percent, blocks", [(4, 85, None), (5, 80, 8)])
def test_links_match_brute_force(spark, corpus, monkeypatch, size, percent, blocks):
    if blocks:  # many blocks a family
        monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", blocks)
        monkeypatch.setattr(ngram_join, "PAIRED_CLASSES", 2)
    got = ngram_join.link_documents(documents(spark, corpus).repartition(3), size, percent)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == brute_components(corpus, size, percent)


def test_a_class_is_one_set_however_its_texts_are_written(spark, monkeypatch):
    """Copies that differ in blanks and capitals alone are compared once."""
    base = text_of(1, 60)
    texts = [base.replace(" ", " " * (1 + i % 40), 1 + i // 40) + " " * i for i in range(200)] + [base.upper(), changed(base, 2, 1)]
    docs = documents(spark, list(enumerate(texts)), False)
    whole = spark.sparkContext.broadcast(np.full(1 << (ngram_join.FIELD_BITS - 6), 2**64 - 1, np.uint64))
    assert ngram_join.class_sets(docs.coalesce(1), 5, whole).count() == 2
    got = ngram_join.link_documents(docs.repartition(3), 5, 80).collect()
    assert len(got) == len(texts) and {r.component_id for r in got} == {0}

    def rows_of_a_task(percent):
        return lambda table: pa.table({"a": [table.num_rows], "b": [0]})

    monkeypatch.setattr(ngram_join, "_compare", rows_of_a_task)
    members = spark.createDataFrame([(1, 9, 50), (2, 9, 50)], "class long, family long, n int")
    sets = spark.createDataFrame([(c, bytes([c]) * 8) for c in (1, 2)] * 20, "class long, set binary")
    assert [r.a for r in ngram_join.family_links(members, sets, 80).collect()] == [2]


def test_packed_sets_keep_their_upper_bytes():
    value = np.sort(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    back = ngram_join.unpacked(pa.array([ngram_join.packed(value)], pa.binary())[0].as_buffer())
    assert (back == (value >> np.uint64(16)) << np.uint64(16)).all() and len(ngram_join.unpacked(b"")) == 0


def test_near_copies_leave_one_of_each(spark, corpus):
    docs = documents(spark, corpus)
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    parts = {(d, t): c for (d, t), c in zip(corpus, row_components(corpus))}
    held = collections.Counter(parts[r] for r in rows)
    assert set(held) == set(parts.values())
    assert all(n == 1 for c, n in held.items() if c[1])
    assert (0, corpus[0][1]) in rows and (302, " \n\t ") in rows
    empty = documents(spark, [])
    assert ngram_join.drop_near_copies(empty).count() == 0
    assert ngram_join.link_documents(empty).count() == 0


def row_components(rows):
    """A name for the component of each row: its rows' smallest place, and whether it has a set."""
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    found = {d: (c, n > 0) for d, n, c in brute_components(numbered, 5, 80)}
    return [found[i] for i in range(len(rows))]


def test_overlaps_match_set_intersections():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 400, r.integers(1, 200))).astype(np.uint64) for _ in range(60)]
    got = ngram_join.overlaps(np.concatenate(sets), np.array([len(s) for s in sets]))
    expected = [[0 if i == j else len(np.intersect1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    np.fill_diagonal(got, 0)
    assert (got == np.array(expected)).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7), (2000, 2001), (2001, 2000)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df, Staging(spark)).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1200)} | {2000: 2000, 2001: 2000}
    assert components(df.filter("false"), Staging(spark)).count() == 0


@pytest.mark.parametrize("fingerprint", [16, 1])
def test_copies_match_brute_force(spark, corpus, fingerprint):
    """With fingerprints of one byte most of them name several chunks, and texts still aren't confused."""
    got = chunk_dedup.find_copies(documents(spark, corpus), fingerprint_bytes=fingerprint)
    groups = collections.defaultdict(list)
    for d, t in corpus:
        groups[t or ""].append(d)
    expected = []
    for d, t in corpus:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        expected.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(expected, key=str)


def test_dropped_copies(spark, corpus):
    docs = documents(spark, corpus)
    kept = chunk_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    rows = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    largest = {}
    for d, t in corpus:
        largest[t or ""] = max(largest.get(t or "", -1), -1 if d is None else d)
    assert rows == sorted(((None if d < 0 else d, t) for t, d in largest.items()), key=str)
    assert chunk_dedup.drop_copies(documents(spark, [])).count() == 0
    assert chunk_dedup.find_copies(documents(spark, [])).count() == 0


def test_chunks_depend_on_content_alone():
    text = text_of(11, 40000).encode()
    data = np.frombuffer(b"x" * 3000 + text, np.uint8)
    (_, moved) = chunk_dedup.chunk_bounds(data, np.array([0, 3000, len(data)]))
    (alone,) = chunk_dedup.chunk_bounds(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert [e - 3000 for e in moved] == alone and len(alone) > 10
    assert max(np.diff([0, *alone])) <= chunk_dedup.MOST


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_overlaps(docs, items):
    windows = collections.defaultdict(set)
    for item, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    rows = []
    for d, t in docs:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        rows.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(rows, key=str)


def test_overlaps_with_a_benchmark(spark, corpus):
    passage = text_of(2, 60)
    items = [(1, passage), (2, " ".join(passage.split()[20:30])), (2, " ".join(passage.split()[20:30])), (3, "one TWO!"), (4, ""),
             (5, None), (None, passage.upper()), (6, corpus[3][1]), (7, " ".join(passage.split()[5:14])), (8, "lone"), (9, "é1 two")]
    docs = corpus + [(900, "x " * 30000 + passage + " end"), (901, "a one, two. b é1-two"), (902, ("word " * 12) + "lone")]
    items += [(10, "word " * 11)]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("marks", F.lit("x"))
    got = decontaminate.find_overlaps(documents(spark, docs).repartition(3), table).drop("key")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_overlaps(docs, items)
    kept = decontaminate.drop_contaminated(documents(spark, docs), table)
    clean = [d for d in docs if not brute_overlaps([d], items)[0][-1]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(clean, key=str)
    assert decontaminate.find_overlaps(documents(spark, []), table).count() == 0
    none = decontaminate.find_overlaps(documents(spark, docs), table.filter("false"))
    assert none.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0 and none.count() == len(docs)


def lengths(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, length int, cluster long")
    return df.withColumn("bin", F.lit("x")).withColumn("shard", F.lit("x"))


@pytest.mark.parametrize("shard", [50, 10_000])
def test_bins_keep_their_promises(spark, shard):
    r = random.Random(4)
    rows = [(i, r.choice(["hot", "hot", "a", "b", None]), r.randint(0, 260), r.choice([None, 1, 2, i])) for i in range(600)]
    rows += [(7000, "a", 1050, 3), (7001, None, 200, None), (7001, None, 200, None), (None, "b", 5, 1), (7002, "b", None, None)]
    got = packing.pack(lengths(spark, rows), capacity=100, shard_pieces=shard).collect()
    by_id = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    about = {(d): (s, c) for d, s, _, c in rows}
    for x in got:
        by_id[x.doc_id].append(x)
        if x.bin_id is not None:
            bins[x.bin_id].append(x)
    total = collections.Counter()
    for d, _, n, _ in rows:
        total[d] += n or 0
    assert {d: sum(x.length for x in v) for d, v in by_id.items()} == dict(total)
    assert sorted(x.start for x in by_id[7000]) == [100 * k for k in range(11)]
    assert len(by_id[7001]) == 4 and [x.bin_id for x in by_id[7002]] == [None]
    for held in bins.values():
        assert sum(x.length for x in held) + held[0].residual == 100
        assert sorted(x.slot for x in held) == list(range(len(held)))
        for k in (0, 1):
            values = [about[x.doc_id][k] for x in held]
            values = [v for v in values if v is not None]
            assert len(values) == len(set(values))
    assert packing.pack(lengths(spark, [])).count() == 0


def test_packing_is_best_fit():
    """Against a plain search through all bins."""
    r = random.Random(9)
    bins, plain = packing.Bins(50), []
    for length, source, cluster in sorted(((r.randint(1, 30), 1 << r.randint(0, 5), 1 << r.randint(0, 40)) for _ in range(800)), reverse=True):
        number = bins.add(length, source, cluster)
        fits = [b for b in plain if b[0] >= length and not b[1] & source and not b[2] & cluster]
        if fits:
            tightest = min(b[0] for b in fits)
            assert number < len(plain) and plain[number] in fits and plain[number][0] == tightest
            b = plain[number]
            b[0], b[1], b[2] = b[0] - length, b[1] | source, b[2] | cluster
        else:
            assert number == len(plain)
            plain.append([50 - length, source, cluster])


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with copies, near copies, benchmark passages and texts without letters, and a benchmark."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 120").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in source]
    long = next(r for r in source if len(r.text.split()) > 150)
    passage = " ".join(f"item{i} word" for i in range(20))
    rows += [(500, long.text, long.lang, "s", 1), (501, changed(long.text, 1, 3), long.lang, "s", 1), (502, "12 34", "en", "s", 5)]
    rows += [(503, long.text[:300] + " " + passage + " " + text_of(3, 30), "en", "s", 1), (504, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    items = [(0, passage), (1, text_of(77, 30))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_pipeline_matches_brute_force(spark, small):
    folder, rows, items = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    largest = {}
    for r in kept:
        if r[0] > largest.get(r[1], (-1,))[0]:
            largest[r[1]] = r
    unique = sorted(largest.values())
    near = {d: c for d, _, c in brute_components([(r[0], r[1]) for r in unique], 5, 80)}
    apart = [r for r in unique if near[r[0]] == r[0]]
    clean = {x[0] for x in brute_overlaps([(r[0], r[1]) for r in apart], items) if not x[-1]}
    expected = [kept, unique, apart, [r for r in apart if r[0] in clean]]
    for (name, stage), wanted in zip(corpus_pipeline.STAGES, expected):
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns
        assert sorted(tuple(r) for r in found.collect()) == sorted(wanted), name
        docs = spark.createDataFrame(wanted, docs.schema)
    assert 503 not in clean and len(apart) < len(unique) < len(kept) < len(rows)
    bins = corpus_pipeline.run(spark, folder)
    total = collections.Counter()
    for r in bins.collect():
        total[r.doc_id] += r.length
    assert total == {r[0]: len(r[1]) for r in expected[-1]}


def test_pipeline_on_an_empty_table(spark, small, tmp_path):
    folder, _, _ = small
    spark.read.parquet(f"{folder}/documents.parquet").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
