"""Cover auto-capture over frame metrics: stateless gates and the per-device state machine.

Frames are (device, ts, blur, mean_lum, signature). The state of a device is a handful of numbers, so it does not
grow with the stream; state of silent devices expires.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class CaptureConfig:
    """Fixed values of the capture rules; times in milliseconds, distances in bits."""

    stable_frames: int = 3
    stable_distance: int = 4
    duplicate_distance: int = 8
    cooldown_ms: int = 1500
    blur_threshold: float = 40.0
    dark_threshold: float = 45.0
    bright_threshold: float = 215.0
    reset_bad_frames: int = 5
    grace_frames: int = 1


DEFAULT = CaptureConfig()
TICKS = "device long, ts timestamp, phase string, stable_count int, capture boolean, steady boolean, signature long"
# previous signature, stable count, cooldown end, accepted signature, bad frames, bad streak, last outcome, last steady
STATE = (
    "previous long, stable int, cooldown_until long, accepted long, bad int, streak int, outcome string, steady boolean, last_seen long"
)
EXPIRE_MS = 600_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # fixed value: the store that keeps timers
START = (None, 0, 0, None, 0, 0, "CAPTURED", False)


def frame_gates(frames: DataFrame, config: CaptureConfig = DEFAULT) -> DataFrame:
    """Adds sharp, too_dark, too_bright, lit and the 0..1 sharpness and brightness. Works on streams as it is."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    dark, bright = F.col("mean_lum") < config.dark_threshold, F.col("mean_lum") > config.bright_threshold
    return frames.select(
        "*", (F.col("blur") >= config.blur_threshold).alias("sharp"), dark.alias("too_dark"), bright.alias("too_bright"),
        (~dark & ~bright).alias("lit"), unit(F.col("blur") / (config.blur_threshold * 2)).alias("sharpness"),
        unit(F.col("mean_lum") / 255.0).alias("brightness"),
    )


def _distance(a: int, b: int) -> int:
    return ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count()


def step(state: tuple, now_ms: int, gate: str, signature: int, config: CaptureConfig) -> tuple[tuple, tuple]:
    """One frame: the new state and (phase, stable_count, capture, steady, signature).

    ``gate`` is OK or the reason the frame is unusable. During the cooldown a frame only repeats the last outcome.
    """
    previous, stable, cooldown, accepted, bad, streak, outcome, steady = state
    if now_ms < cooldown:
        return state, (outcome, 0, False, steady, None)
    if gate != "OK":
        bad, streak = bad + 1, streak + 1
        if streak > config.grace_frames:
            previous, stable = None, 0
        if bad >= config.reset_bad_frames:
            accepted, bad = None, 0
        return (previous, stable, cooldown, accepted, bad, streak, outcome, False), (gate, stable, False, False, None)
    steady = previous is not None and _distance(previous, signature) <= config.stable_distance
    stable = stable + 1 if steady else 0
    if stable < config.stable_frames:
        kept = (signature, stable, cooldown, accepted, 0, 0, outcome, steady)
        return kept, ("STABILIZING", stable, False, steady, signature)
    known = accepted is not None and _distance(accepted, signature) <= config.duplicate_distance
    outcome = "SAME_COVER" if known else "CAPTURED"
    kept = (None, 0, now_ms + config.cooldown_ms, accepted if known else signature, 0, 0, outcome, steady)
    return kept, (outcome, 0 if known else config.stable_frames, not known, True, signature)


def gate(config: CaptureConfig = DEFAULT) -> Column:
    """OK, or why a frame cannot be used; a frame without a figure or a signature is not held still."""
    usable = (F.col("blur") >= config.blur_threshold) & F.col("mean_lum").isNotNull() & F.col("signature").isNotNull()
    return (
        F.when(~F.coalesce(usable, F.lit(False)), "HOLD_STILL").when(F.col("mean_lum") < config.dark_threshold, "TOO_DARK")
        .when(F.col("mean_lum") > config.bright_threshold, "TOO_BRIGHT").otherwise("OK")
    )


def _prepared(frames: DataFrame, config: CaptureConfig) -> DataFrame:
    """Frames keyed by (known, device), so that frames without a device are one device of their own; frames without a time
    have no place in any order and are left out."""
    ts, number = F.col("ts").cast("timestamp"), lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    return frames.filter(ts.isNotNull()).select(
        F.col("device").isNotNull().alias("known"), number("device"), ts.alias("ts"), F.unix_millis(ts).alias("now_ms"),
        gate(config).alias("gate"), number("signature"),
    )


def _named(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("device", F.when(F.col("known"), F.col("device"))).drop("known")


def _run(pdf: pd.DataFrame, state: tuple, config: CaptureConfig, expire_ms: int) -> tuple[tuple, pd.DataFrame]:
    """Step the frames of one device in event order. ``state`` ends with the time of its last frame: a device silent for
    longer than ``expire_ms`` starts anew, whatever trigger or batch its next frame comes in."""
    out = []
    state, last_seen = state[:-1], state[-1]
    for row in pdf.sort_values(["now_ms", "signature"], kind="stable").itertuples(index=False):
        now = int(row.now_ms)
        if last_seen is not None and now - last_seen > expire_ms:
            state = START
        last_seen = now
        state, tick = step(state, now, row.gate, int(row.signature), config)
        out.append((row.known, row.device, row.ts, *tick))
    names = ["known", "device", "ts", "phase", "stable_count", "capture", "steady", "signature"]
    ticks = pd.DataFrame([t[:-1] for t in out], columns=names[:-1])
    ticks[names[-1]] = pd.array([t[-1] for t in out], dtype="Int64")  # never through doubles: signatures have 64 bits
    return (*state, last_seen), ticks


class Device(StatefulProcessor):
    """The state of one device: one row of numbers, and one timer that forgets it when it has been silent long enough."""

    def __init__(self, config: CaptureConfig, expire_ms: int):
        self.config, self.expire_ms = config, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("device", STATE)

    def _forget_at(self, last_seen: int) -> int:
        return last_seen + self.expire_ms + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        current = self.state.get() if self.state.exists() else (*START, None)
        before = current[-1]
        current, ticks = _run(pd.concat(list(rows), ignore_index=True), tuple(current), self.config, self.expire_ms)
        self.state.update(current)
        if before is not None:
            self.handle.deleteTimer(self._forget_at(before))
        self.handle.registerTimer(self._forget_at(current[-1]))
        yield ticks

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def capture_events(
    frames: DataFrame, config: CaptureConfig = DEFAULT, delay: str = "10 seconds", expire_ms: int = EXPIRE_MS
) -> DataFrame:
    """Ticks of a frame stream, keyed by device. How the frames fall into triggers makes no difference: a silent device starts
    anew by its own frames' times, and its event-time timer only frees its memory after that.

    Rows later than the watermark are dropped before they reach the state; count them with the query's progress
    (numRowsDroppedByWatermark). The frames of one device in one trigger are sorted together, so bound the trigger
    (maxFilesPerTrigger, maxOffsetsPerTrigger), not the device. The state store must be RocksDB (``STORE``).
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    watermarked = _prepared(frames, config).withWatermark("ts", delay)
    ticks = watermarked.groupBy("known", "device").transformWithStateInPandas(
        statefulProcessor=Device(config, expire_ms), outputStructType=f"known boolean, {TICKS}", outputMode="Append", timeMode="EventTime"
    )
    return _named(ticks)


def capture_events_batch(frames: DataFrame, config: CaptureConfig = DEFAULT, expire_ms: int = EXPIRE_MS) -> DataFrame:
    """The same ticks over a finished table.

    The rows of a device arrive sorted and in Arrow batches, and only the small state is kept between them, so a
    device with any number of frames fits; devices are spread by hash.
    """
    keys = ["known", "device"]
    ordered = _prepared(frames, config).repartition(*keys).sortWithinPartitions(*keys, "now_ms", "signature")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, state = None, (*START, None)
        for pdf in batches:
            for key, rows in pdf.groupby(keys, sort=False):
                if key != device:
                    device, state = key, (*START, None)
                state, ticks = _run(rows, state, config, expire_ms)
                yield ticks

    return _named(ordered.mapInPandas(walk, f"known boolean, {TICKS}"))


def captures(ticks: DataFrame) -> DataFrame:
    return ticks.filter("capture").select("device", "ts", "signature")
