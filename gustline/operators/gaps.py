"""Lost packets and drifting sample periods.

Two of the reader's rules hold a value and replace it depending on that value,
so neither has a closed window form:

* a synchronised sensor keeps an anchor and re-anchors on a packet whose
  (detrended) clock strays from it by more than the slack;
* an inertial sensor keeps a period and accepts a measured one that is close.

:func:`held_values` runs such a rule exactly, in parallel within a key, as a scan.
What a block of rows does to the value that comes in is a map with few pieces:
an incoming value is either held throughout, or it is replaced at the first row
that its rule fires on, and what follows then no longer depends on it.  Only rows
that are the first for some value matter, each with what comes out in the end.
Such maps compose, so the value that enters every block follows from them alone,
and each block is run once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gustline import catalogue as cat
from gustline.operators.ordered import BLOCK_ROWS, block_of, ordinals, previous_row
from gustline.session import broadcast_if_small, join_with_nulls

PACKET_KEYS = ["session_id", "packet_origin", "sensor_name"]
_BLOCK = "_block"

# rule name -> should candidate replace the held value, given the tolerance
RULES = {
    "strays": lambda candidate, held, tolerance: abs(candidate - held) > tolerance,
    "close": lambda candidate, held, tolerance: abs(candidate - held) < tolerance * held,
    "elapsed": lambda candidate, held, tolerance: candidate - held >= tolerance,
}


def _first(found: np.ndarray, start: int) -> int:
    """First true position at or after ``start`` (the length if none)."""
    step = 64
    while start < len(found):
        part = found[start : start + step]
        if part.any():
            return start + int(part.argmax())
        start += step
        step *= 4
    return len(found)


def _next_hit(candidates, held, tolerances, rule, start) -> int:
    step = 64
    while start < len(candidates):
        hit = RULES[rule](candidates[start : start + step], held, tolerances[start : start + step])
        if hit.any():
            return start + int(hit.argmax())
        start += step
        step *= 4
    return len(candidates)


def run_rule(candidates: np.ndarray, tolerances: np.ndarray, rule: str, held: float) -> tuple[np.ndarray, np.ndarray]:
    """Value held after each row, and whether the row replaced it.  NaN candidates never replace."""
    values = np.empty(len(candidates))
    replaced = np.zeros(len(candidates), dtype=bool)
    # rows at which the rule would not fire if the row before had just been taken over
    chain_ends = np.ones(len(candidates), dtype=bool)
    with np.errstate(invalid="ignore"):
        chain_ends[1:] = ~RULES[rule](candidates[1:], candidates[:-1], tolerances[1:])
        at = 0
        while at < len(candidates):
            hit = _next_hit(candidates, held, tolerances, rule, at)
            values[at:hit] = held
            if hit == len(candidates):
                break
            end = _first(chain_ends, hit + 1)
            values[hit:end] = candidates[hit:end]
            replaced[hit:end] = True
            held = candidates[end - 1]
            at = end
    return values, replaced


def _start_value(candidates: np.ndarray, initial: float) -> float:
    """Without an incoming value the rule starts from the initial one, else from its first real candidate."""
    if not np.isnan(initial):
        return initial
    real = candidates[~np.isnan(candidates)]
    return real[0] if len(real) else np.nan


def _fires(rule: str, candidates: np.ndarray, tolerances: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Held values that each row replaces, as two open intervals; widened by ``slack`` of their scale, or narrowed."""
    margin = slack * (np.abs(candidates) + np.where(np.isfinite(tolerances), np.abs(tolerances), 0))
    low, high = np.full(len(candidates), np.inf), np.full(len(candidates), -np.inf)
    with np.errstate(all="ignore"):
        if rule == "strays":
            return np.full(len(candidates), -np.inf), candidates - tolerances + margin, candidates + tolerances - margin, low
        if rule == "elapsed":
            return np.full(len(candidates), -np.inf), candidates - tolerances + margin, low, high
        above = np.where(tolerances < 1, candidates / (1 - tolerances), np.inf)
        above[(tolerances == 1) & (candidates <= 0)] = -np.inf
        below = np.maximum(candidates / (1 + tolerances), 0)
        below = np.where(tolerances > 1, np.maximum(below, candidates / (1 - tolerances)), below)
        return below - margin, above + margin, low, high


def _without(parts: list[tuple[float, float]], low: float, high: float) -> list[tuple[float, float]]:
    """Intervals less the interval between ``low`` and ``high``."""
    if not low < high:
        return parts
    out = []
    for a, b in parts:
        if high <= a or low >= b:
            out.append((a, b))
        else:
            out += [part for part in ((a, low), (high, b)) if part[0] < part[1]]
    return out


def _first_half_lines(candidates: np.ndarray, tolerances: np.ndarray, at: np.ndarray, rule: str) -> np.ndarray:
    """:func:`first_hits` among rows ``at``, of rules whose rows replace all below a value, and some all above one.

    What no row has taken yet is a single interval, whose ends are running extremes.
    """
    at = at[~np.isnan(tolerances[at])]
    if not len(at):
        return at
    wide = _fires(rule, candidates[at], tolerances[at], 1e-9)
    close = _fires(rule, candidates[at], tolerances[at], -1e-9)
    low = np.concatenate([[-np.inf], np.maximum.accumulate(close[1])[:-1]])
    high = np.concatenate([[np.inf], np.minimum.accumulate(close[2])[:-1]])
    found = ((wide[1] > low) | (wide[2] < high)) & (low < high)
    return at[found]


def first_hits(candidates: np.ndarray, tolerances: np.ndarray, rule: str) -> np.ndarray:
    """Rows that may be the first to replace some incoming value, in order.

    Each row takes from the line of values those that it replaces; a row that finds none of its own left is no first.
    Rounding is allowed for on the side of too many rows.
    """
    pairs = np.stack([candidates, tolerances], axis=1)
    _, first = np.unique(pairs, axis=0, return_index=True)
    first.sort()
    first = first[~np.isnan(candidates[first])]
    if rule != "close":
        return _first_half_lines(candidates, tolerances, first, rule)
    wide = _fires(rule, candidates[first], tolerances[first], 1e-9)
    close = _fires(rule, candidates[first], tolerances[first], -1e-9)
    parts, found, at = [(-np.inf, np.inf)], [], 0
    step = 64
    while at < len(first) and parts:
        span = slice(at, at + step)
        hit = np.zeros(len(wide[0][span]), bool)
        for a, b in parts:
            hit |= (wide[0][span] < b) & (wide[1][span] > a) & (wide[0][span] < wide[1][span])
            hit |= (wide[2][span] < b) & (wide[3][span] > a) & (wide[2][span] < wide[3][span])
        if not hit.any():
            at, step = at + step, step * 4
            continue
        at, step = at + int(hit.argmax()), 64
        found.append(first[at])
        parts = _without(_without(parts, close[0][at], close[1][at]), close[2][at], close[3][at])
        at += 1
    return np.array(found, np.int64)


def rule_map(candidates: np.ndarray, tolerances: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a block does to an incoming value: candidate and tolerance of its first hits, and what each leads to.

    An incoming value leads to what belongs to the first of these rows that replaces it, or stays.
    """
    hits = first_hits(candidates, tolerances, rule)
    outs = np.empty(len(hits))
    if not len(hits):
        return candidates[hits], tolerances[hits], outs
    begin = hits[0]
    values, replaced = run_rule(candidates[begin + 1 :], tolerances[begin + 1 :], rule, candidates[begin])
    last = values[-1] if len(values) else candidates[begin]
    known = dict.fromkeys([begin, *(begin + 1 + np.flatnonzero(replaced)).tolist()], last)
    for k, hit in enumerate(hits.tolist()):
        path, at = [], hit
        while at not in known:
            path.append(at)
            following = _next_hit(candidates, candidates[at], tolerances, rule, at + 1)
            if following == len(candidates):
                known[at] = candidates[at]
            else:
                at = following
        outs[k] = known[at]
        known.update(dict.fromkeys(path, outs[k]))
    return candidates[hits], tolerances[hits], outs


def through(held: float, block: tuple[np.ndarray, np.ndarray, np.ndarray], rule: str) -> float:
    """What an incoming value has become after a block."""
    candidates, tolerances, outs = block
    if np.isnan(held) or not len(candidates):
        return held
    hit = RULES[rule](candidates, held, tolerances)
    return float(outs[hit.argmax()]) if hit.any() else held


def _all_through(held: np.ndarray, block: tuple[np.ndarray, np.ndarray, np.ndarray], rule: str) -> np.ndarray:
    """:func:`through` of many values."""
    candidates, tolerances, outs = block
    if not len(candidates) or not len(held):
        return held.copy()
    if rule == "close":
        return np.array([through(h, block, rule) for h in held])
    # the first row that may replace each value; rounding is allowed for, so the rule itself has the last word
    wide = _fires(rule, candidates, tolerances, 1e-9)
    row = np.searchsorted(np.maximum.accumulate(wide[1]), held, side="right")
    if rule == "strays":
        row = np.minimum(row, np.searchsorted(-np.minimum.accumulate(wide[2]), -held, side="right"))
    result = held.copy()
    some = np.flatnonzero((row < len(candidates)) & ~np.isnan(held))
    at = row[some]
    sure = RULES[rule](candidates[at], held[some], tolerances[at])
    result[some[sure]] = outs[at[sure]]
    for k, start in zip(some[~sure].tolist(), at[~sure].tolist()):
        hit = _next_hit(candidates, held[k], tolerances, rule, start + 1)
        if hit < len(candidates):
            result[k] = outs[hit]
    return result


def compose(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The map of blocks in a row.

    Blocks are put before what follows them one by one, from the last: what a block's rows lead to is looked up in a
    single map, whatever the number of blocks behind it.
    """
    whole, pruned = blocks[-1], len(blocks[-1][0])
    for block in reversed(blocks[:-1]):
        outs = _all_through(np.asarray(block[2], float), whole, rule)
        whole = tuple(np.concatenate(pair) for pair in zip((block[0], block[1], outs), whole))
        if len(whole[0]) > 2 * pruned + 64:
            kept = first_hits(whole[0], whole[1], rule)
            whole, pruned = tuple(part[kept] for part in whole), len(kept)
    kept = first_hits(whole[0], whole[1], rule)
    return tuple(part[kept] for part in whole)


#: Blocks whose maps are composed into one.
FAN = 256
_MAP = "_candidates array<double>, _tolerances array<double>, _outs array<double>, _start double"


def _maps(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    columns = (pdf["_candidates"], pdf["_tolerances"], pdf["_outs"])
    return [tuple(np.asarray(x, float) for x in row) for row in zip(*columns)]


def _first_start(starts: pd.Series) -> float:
    real = starts.dropna()
    return float(real.iloc[0]) if len(real) else np.nan


def held_values(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    candidate: str,
    tolerance: str,
    rule: str,
    initial: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Runs a hold-or-replace rule along each key.

    Adds ``held_before``, ``held`` and ``replaced``.  ``initial`` names a column
    with the value held before the key's first row; without it (or where it is
    null) the key's first candidate is held from the start.

    Rows are shuffled once, by key and block; their maps and the run itself read the same shuffle.  Maps of FAN blocks
    are composed, so that the chain along a key has one row for as many blocks.
    """
    keys, fan = list(keys), FAN
    start = F.col(initial).cast("double") if initial else F.lit(None).cast("double")
    rows = df.select(
        "*",
        block_of(order, block_rows).alias(_BLOCK),
        F.col(candidate).cast("double").alias("_candidate"),
        F.col(tolerance).cast("double").alias("_tolerance"),
        start.alias("_initial"),
    )
    place = rows.select(*keys, _BLOCK).schema
    placed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in place)
    keyed = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in place])

    def doubles(table: pa.Table, name: str) -> np.ndarray:
        return table[name].to_numpy().astype(float)

    def summarise(table: pa.Table) -> pa.Table:
        table = table.select([*keys, _BLOCK, order, "_candidate", "_tolerance", "_initial"]).sort_by(order)
        candidates = doubles(table, "_candidate")
        found = rule_map(candidates, doubles(table, "_tolerance"), rule)
        out = table.select([*keys, _BLOCK]).slice(0, 1).cast(keyed)
        for name, values in zip(("_candidates", "_tolerances", "_outs"), found):
            out = out.append_column(name, pa.array([values.tolist()], pa.list_(pa.float64())))
        first = _start_value(candidates, doubles(table, "_initial")[0])
        return out.append_column("_start", pa.array([first], pa.float64()))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_BLOCK)
        candidates, tolerances, outs = compose(_maps(pdf), rule)
        own = {"_candidates": [candidates], "_tolerances": [tolerances], "_outs": [outs], "_start": [_first_start(pdf["_start"])]}
        head = pdf.iloc[[0]][keys].reset_index(drop=True)
        return head.assign(_run=pdf[_BLOCK].iloc[0] // fan, **own)

    def enter(pdf: pd.DataFrame, held: float) -> list[float]:
        """What enters each row's block or run, in order."""
        entering = []
        for block, first in zip(_maps(pdf), pdf["_start"]):
            held = first if np.isnan(held) else held
            entering.append(held)
            held = through(held, block, rule)
        return entering

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_run").reset_index(drop=True)
        return pdf[[*keys, "_run"]].assign(_held=enter(pdf, np.nan))

    def unfold(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_BLOCK).reset_index(drop=True)
        held = float(known["_held"].iloc[0]) if known["_held"].notna().any() else np.nan
        return pdf[[*keys, _BLOCK]].assign(_incoming=enter(pdf, held))

    def emit(table: pa.Table, known: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        incoming = doubles(known, "_incoming")[0]
        held, replaced = run_rule(doubles(table, "_candidate"), doubles(table, "_tolerance"), rule, incoming)
        table = table.select(df_columns)
        for name, values in (("held_before", np.concatenate([[incoming], held[:-1]])), ("held", held)):
            table = table.append_column(name, pa.array(values, from_pandas=True))
        return table.append_column("replaced", pa.array(replaced))

    df_columns = df.columns
    run = F.floor(F.col(_BLOCK) / fan).cast("bigint").alias("_run")
    named = placed.rsplit(",", 1)[0] if keys else ""
    grouped = rows.groupBy(*keys, _BLOCK)
    maps = grouped.applyInArrow(summarise, f"{placed}, {_MAP}")
    folded = maps.groupBy(*keys, run).applyInPandas(fold, f"{named}, _run bigint, {_MAP}")
    chained = folded.groupBy(*keys).applyInPandas(chain, f"{named}, _run bigint, _held double")
    by_run = maps.groupBy(*keys, run).cogroup(chained.groupBy(*keys, "_run"))
    incoming = by_run.applyInPandas(unfold, f"{placed}, _incoming double")
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("held_before", T.DoubleType()),
            T.StructField("held", T.DoubleType()),
            T.StructField("replaced", T.BooleanType()),
        ]
    )
    return grouped.cogroup(incoming.groupBy(*keys, _BLOCK)).applyInArrow(emit, schema)


def lag_gaps(
    packets: DataFrame, keys: Sequence[str], clock: str, expected: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Plain gap: time since the previous packet beyond the expected spacing (null on a key's first packet)."""
    placed = previous_row(packets, keys, "seq", {clock: "previous_clock"}, block_rows)
    return placed.withColumn("gap", F.col(clock) - F.col("previous_clock") - F.col(expected))


def _with_carried(packets: DataFrame, carried: DataFrame | None, keys: Sequence[str], columns: dict) -> DataFrame:
    """State of earlier packets, one row per key, beside the packets of its key."""
    if carried is None:
        return packets.select("*", *[F.lit(None).cast(kind).alias(f"_carried_{c}") for c, kind in columns.items()])
    state = carried.select(*keys, *[F.col(c).alias(f"_carried_{c}") for c in columns])
    return join_with_nulls(packets, broadcast_if_small(state), list(keys), "left")


LOST_STATE = {"packets_before": "bigint", "anchor": "double"}
DRIFT_STATE = {"last_ticks": "bigint", "current_period": "double"}


def lost_sets(
    packets: DataFrame,
    slack_seconds: float = 0.005,
    block_rows: int = BLOCK_ROWS,
    keys: Sequence[str] = PACKET_KEYS,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Lost packets of synchronised sensors.

    Needs ``node_ticks``, ``samples_in_packet`` and ``period``.  Adds the packet
    ordinal, ``is_first``, ``lost``, ``gap_ms`` (null unless lost) and
    ``ideal_time`` in seconds.  Microphones run free: never lost, never re-anchored.
    ``carried`` (keys and LOST_STATE) continues keys from earlier packets.
    """
    step = F.col("samples_in_packet") * F.col("period") * F.lit(cat.NODE_CLOCK_HZ)
    known = _with_carried(packets, carried, keys, LOST_STATE)
    numbered = ordinals(known, keys, "seq", "packet_ordinal", block_rows).withColumn(
        "packet_ordinal", F.col("packet_ordinal") + F.coalesce("_carried_packets_before", F.lit(0))
    )
    ready = numbered.select(
        "*",
        (F.col("node_ticks") - (F.col("packet_ordinal") - 1) * step).alias("_offset"),
        F.when(F.col("sensor_name") == cat.MICROPHONE, F.lit(float("inf")))
        .otherwise(F.lit(slack_seconds * cat.NODE_CLOCK_HZ))
        .alias("_slack"),
    )
    held = held_values(ready, keys, "seq", "_offset", "_slack", "strays", "_carried_anchor", block_rows)
    ideal = F.col("held") + (F.col("packet_ordinal") - 1) * step
    return held.select(
        *packets.columns,
        "packet_ordinal",
        (F.col("packet_ordinal") == 1).alias("is_first"),
        F.col("replaced").alias("lost"),
        F.when(
            F.col("replaced"), (F.col("_offset") - F.col("held_before")) / F.lit(cat.NODE_CLOCK_HZ) * 1000
        ).alias("gap_ms"),
        (ideal / F.lit(cat.NODE_CLOCK_HZ)).alias("ideal_time"),
        F.col("held").alias("anchor"),
    )


def lost_state(gaps: DataFrame, carried: DataFrame | None = None, keys: Sequence[str] = PACKET_KEYS) -> DataFrame:
    """What :func:`lost_sets` needs of these packets to go on with later ones."""
    latest = gaps.groupBy(*keys).agg(
        F.max("packet_ordinal").alias("packets_before"), F.max_by("anchor", "seq").alias("anchor")
    )
    return _merge_state(latest, carried, keys)


def drift_state(drift: DataFrame, carried: DataFrame | None = None, keys: Sequence[str] = PACKET_KEYS) -> DataFrame:
    """What :func:`period_drift` needs of these packets to go on with later ones."""
    latest = drift.groupBy(*keys).agg(
        F.max_by("node_ticks", "seq").alias("last_ticks"), F.max_by("current_period", "seq").alias("current_period")
    )
    return _merge_state(latest, carried, keys)


def _merge_state(latest: DataFrame, carried: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    if carried is None:
        return latest
    return latest.unionByName(join_with_nulls(carried, latest, list(keys), "left_anti").select(*latest.columns))


def period_drift(
    packets: DataFrame,
    max_drift: float = 0.02,
    block_rows: int = BLOCK_ROWS,
    keys: Sequence[str] = PACKET_KEYS,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Adaptive period of inertial sensors.

    The spacing of two packets gives a measured period; within ``max_drift`` of
    the current one it is taken over, else a packet was lost.  Adds
    ``is_first``, ``measured_period``, ``current_period``, ``lost`` and ``gap_ms``.
    ``carried`` (keys and DRIFT_STATE) continues keys from earlier packets.
    """
    known = _with_carried(packets, carried, keys, DRIFT_STATE)
    placed = previous_row(known, keys, "seq", {"node_ticks": "_before"}, block_rows).select(
        "*", F.coalesce("_carried_current_period", F.col("period")).alias("_period")
    )
    placed = placed.withColumn("_before", F.coalesce("_before", "_carried_last_ticks"))
    spacing = F.col("node_ticks") - F.col("_before")
    ready = placed.select(
        "*",
        (spacing / F.col("samples_in_packet") / F.lit(cat.NODE_CLOCK_HZ)).alias("measured_period"),
        F.lit(max_drift).alias("_drift"),
    )
    held = held_values(ready, keys, "seq", "measured_period", "_drift", "close", "_period", block_rows)
    lost = F.col("_before").isNotNull() & ~F.col("replaced")
    return held.select(
        *packets.columns,
        F.col("_before").isNull().alias("is_first"),
        "measured_period",
        F.col("held").alias("current_period"),
        lost.alias("lost"),
        F.when(lost, spacing / F.lit(cat.NODE_CLOCK_HZ) * 1000).alias("gap_ms"),
    )


def gap_report(gaps: DataFrame, keys: Sequence[str] = PACKET_KEYS) -> DataFrame:
    """Packets, losses and summed gap per key."""
    return gaps.groupBy(*keys).agg(
        F.count("*").alias("packets"),
        F.count_if("lost").alias("lost_packets"),
        F.coalesce(F.sum("gap_ms"), F.lit(0.0)).alias("total_gap_ms"),
    )
