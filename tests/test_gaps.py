import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustline.operators import gaps, windows
from gustline.session import cut_lineage

SCHEMA = (
    "session_id string, seq bigint, packet_origin string, sensor_name string, node_ticks bigint, "
    "samples_in_packet int, period double"
)


@pytest.mark.parametrize("rule,tolerance", [("strays", 3.0), ("close", 0.02), ("elapsed", 10.0)])
def test_rule_runs_like_a_plain_loop(rule, tolerance):
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = rng.integers(1, 300)
        values = {
            "strays": rng.normal(0, 1, n).cumsum(),
            "close": 1 + 0.02 * rng.normal(0, 1, n) * rng.choice([0.1, 1, 3]),
            "elapsed": rng.exponential(rng.choice([0.1, 3, 20]), n).cumsum(),
        }[rule]
        values[rng.random(n) < 0.05] = np.nan
        held, expected, fired = 1.0, [], []
        for v in values:
            hit = bool(gaps.RULES[rule](v, held, tolerance))
            held = v if hit else held
            expected.append(held)
            fired.append(hit)
        got, replaced = gaps.run_rule(values, np.full(n, tolerance), rule, 1.0)
        assert list(got) == expected and list(replaced) == fired


def draw(rng, rule, n):
    values = {
        "strays": rng.normal(0, 1, n).cumsum() if rng.random() < 0.8 else rng.integers(-5, 5, n).astype(float),
        "close": rng.choice([1 + 0.02 * rng.normal(0, 1, n), rng.choice([1.0, 1.5, 2.25, 0.5, 40.0], n), rng.normal(0, 5, n)]),
        "elapsed": rng.exponential(rng.choice([0.1, 3, 20]), n).cumsum(),
    }[rule]
    values[rng.random(n) < 0.05] = np.nan
    return values, np.full(n, {"strays": 3.0, "close": rng.choice([0.02, 0.5, 1.0, 1.5]), "elapsed": 10.0}[rule])


@pytest.mark.parametrize("rule", ["strays", "close", "elapsed"])
def test_map_of_a_block_is_what_the_rule_does(rule):
    """For any incoming value, also at the very edge of a piece, and for blocks in a row."""
    rng = np.random.default_rng(3)
    for _ in range(250):
        blocks = [draw(rng, rule, rng.integers(1, 80)) for _ in range(rng.integers(1, 5))]
        maps = [gaps.rule_map(*block, rule) for block in blocks]
        whole = gaps.compose(maps, rule)
        values = np.concatenate([b[0] for b in blocks])
        edges = [v * f + d for v in values[~np.isnan(values)][:6] for f in (1, 1 / 1.02, 1 / 0.98, 2, 1 / 1.5) for d in (0, 3, -3, 10, -10)]
        for incoming in [*rng.normal(0, 8, 15), *rng.uniform(0.5, 2, 10), *edges]:
            held = incoming
            for block, known in zip(blocks, maps):
                expected = gaps.run_rule(*block, rule, held)[0][-1]
                assert gaps.through(held, known, rule) == expected
                held = expected
            assert gaps.through(incoming, whole, rule) == held


def test_maps_have_few_pieces():
    rng = np.random.default_rng(4)
    n = 50_000
    steady = rng.normal(100, 1, n)
    assert len(gaps.rule_map(steady, np.full(n, 0.02), "close")[0]) < 200
    assert len(gaps.rule_map(rng.normal(0, 50, n), np.full(n, 300.0), "strays")[0]) < 60


def test_rows_are_read_and_shuffled_once(spark):
    """The maps and the run share one shuffle, also where a key has several runs of blocks."""
    rng = random.Random(6)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [(k, i, 1 + rng.gauss(0, 0.03)) for k in ("a", "b", None) for i in range(400)]
    schema = "k string, seq bigint, v double"
    frame = spark.createDataFrame(rows, schema).mapInPandas(count, schema)
    frame = frame.withColumn("t", F.lit(0.05)).withColumn("payload", F.lit(b"x"))
    found = gaps.held_values(frame, ["k"], "seq", "v", "t", "close", None, 1).collect()
    assert seen.value == len(rows) == len(found)
    assert gaps.FAN < 400
    for key in ("a", "b", None):
        mine = sorted((r.seq, r.v, r.held_before, r.held, r.replaced, bytes(r.payload)) for r in found if r.k == key)
        held = mine[0][1]
        for _, v, before, after, replaced, payload in mine:
            hit = abs(v - held) < 0.05 * held
            assert (before, replaced, payload) == (held, hit, b"x")
            held = v if hit else held
            assert after == held


def packets(spark, count=900):
    rng, ticks, rows = random.Random(5), {}, []
    for i in range(count):
        key = rng.choice("0001"), rng.choice(["Baros_P", "Diff_Baros", "Mics"])
        n, period = {"Baros_P": (1, 0.01), "Diff_Baros": (24, 0.001), "Mics": (8, 1 / 15625)}[key[1]]
        jump = (1 if rng.random() > 0.02 else rng.choice([3, 40])) * (1 + rng.choice([0, 0, 0.003]))
        ticks[key] = ticks.get(key, 5000.0) + n * period * 65536 * jump + rng.gauss(0, 30)
        rows.append(("s", i, *key, int(ticks[key]), n, period))
    return rows, spark.createDataFrame(rows, SCHEMA)


def lost_by_loop(rows):
    ideal, result = {}, {}
    for _, seq, origin, sensor, ticks, n, period in rows:
        key, lost, gap = (origin, sensor), False, None
        if key not in ideal:
            ideal[key] = ticks
        else:
            ideal[key] += n * period * 65536
            if sensor != "Mics" and abs(ideal[key] - ticks) > 0.005 * 65536:
                lost, gap, ideal[key] = True, (ticks - ideal[key]) / 65536 * 1000, ticks
        result[seq] = (lost, gap, ideal[key] / 65536)
    return result


def drift_by_loop(rows):
    last, periods, result = {}, {}, {}
    for _, seq, origin, sensor, ticks, n, period in rows:
        key, lost = (origin, sensor), False
        current = periods.setdefault(key, period)
        if key in last:
            measured = (ticks - last[key]) / n / 65536
            lost = not abs(measured - current) / current < 0.02
            periods[key] = current if lost else measured
        last[key] = ticks
        result[seq] = (lost, periods[key])
    return result


def check_lost(found, expected):
    for r in found:
        lost, gap, ideal = expected[r.seq]
        assert r.lost == lost and abs(r.ideal_time - ideal) < 1e-6
        assert (r.gap_ms is None) == (gap is None) and (gap is None or abs(r.gap_ms - gap) < 1e-6)


@pytest.mark.parametrize("block_rows", [150, 1 << 18])
def test_lost_sets(spark, block_rows):
    rows, frame = packets(spark)
    found = gaps.lost_sets(frame, block_rows=block_rows).collect()
    assert len(found) == len(rows) and sum(r.lost for r in found) > 4
    assert sum(r.is_first for r in found) == 6
    check_lost(found, lost_by_loop(rows))
    report = gaps.gap_report(gaps.lost_sets(frame, block_rows=block_rows)).collect()
    assert sum(r.lost_packets for r in report) == sum(r.lost for r in found)
    assert all(r.lost_packets == 0 for r in report if r.sensor_name == "Mics")


@pytest.mark.parametrize("block_rows", [150, 1 << 18])
def test_period_drift(spark, block_rows):
    rows, frame = packets(spark)
    expected = drift_by_loop(rows)
    for r in gaps.period_drift(frame, block_rows=block_rows).collect():
        assert r.lost == expected[r.seq][0] and abs(r.current_period - expected[r.seq][1]) < 1e-9


def test_state_carries_over(spark):
    rows, _ = packets(spark, 600)
    carried, drifted, found, drifts = None, None, [], []
    for low in (0, 300):
        part = spark.createDataFrame(rows[low : low + 300], SCHEMA)
        result = cut_lineage(gaps.lost_sets(part, carried=carried))
        carried = cut_lineage(gaps.lost_state(result, carried))
        found += result.collect()
        drift = cut_lineage(gaps.period_drift(part, carried=drifted))
        drifted = cut_lineage(gaps.drift_state(drift, drifted))
        drifts += drift.collect()
    check_lost(found, lost_by_loop(rows))
    expected = drift_by_loop(rows)
    assert all(r.lost == expected[r.seq][0] for r in drifts)


def test_lag_gaps_and_arrival_windows(spark):
    frame = spark.createDataFrame(
        [("s", "0", "A", i, t, 10.0) for i, t in enumerate([0.0, 10.0, 25.0, 26.0])],
        "session_id string, packet_origin string, sensor_name string, seq bigint, t double, expected double",
    )
    got = gaps.lag_gaps(frame, gaps.PACKET_KEYS, "t", "expected", 2).orderBy("seq").collect()
    assert [r.gap for r in got] == [None, 0.0, 5.0, -9.0]
    numbered = windows.arrival_windows(frame, "t", 10.0, block_rows=2).orderBy("seq").collect()
    assert [r.window_number for r in numbered] == [0, 1, 2, 2]


def test_packets_of_unnamed_sensors_stay(spark):
    rows = [(i, "1", name, 16384 * i, 1, 1.0) for i in range(3) for name in ("Acc", None)]
    packets = spark.createDataFrame(
        [(2 * k + j, *r[1:]) for j in range(1) for k, r in enumerate(rows)],
        "seq bigint, packet_origin string, sensor_name string, node_ticks bigint, samples_in_packet int, period double",
    ).withColumn("session_id", F.lit("s"))
    keys = ["session_id", "packet_origin", "sensor_name"]
    for block_rows in (2, 100):
        assert gaps.lost_sets(packets, block_rows=block_rows, keys=keys).where("sensor_name is null").count() == 3
        assert gaps.period_drift(packets, block_rows=block_rows, keys=keys).where("sensor_name is null").count() == 3


@pytest.mark.parametrize("rule", ["strays", "elapsed"])
def test_maps_of_many_blocks_are_composed_in_time(rule):
    """All rows of a rising clock are pieces of its map; each is looked up once, not in every later block."""
    rng = np.random.default_rng(5)
    values = rng.exponential(1.0, 256 * 300).cumsum()
    tolerances = np.full(len(values), {"strays": 3.0, "elapsed": 10.0}[rule])
    blocks = [(values[at : at + 300], tolerances[at : at + 300]) for at in range(0, len(values), 300)]
    maps = [gaps.rule_map(*block, rule) for block in blocks]
    begin = time.process_time()
    whole = gaps.compose(maps, rule)
    assert time.process_time() - begin < 8
    for incoming in [-1e9, 0.0, *rng.uniform(0, values[-1], 20), values[-1], 1e9]:
        assert gaps.through(incoming, whole, rule) == gaps.run_rule(values, tolerances, rule, incoming)[0][-1]
    assert len(gaps.rule_map(np.full(500, 7.0), np.full(500, 2.0), rule)[0]) == 1
