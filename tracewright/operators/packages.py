"""Package hints: which kind of package the layout of a component's pads looks like."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signature:
    """What a package asks of its pads; None asks nothing. drilled is whether all pads or none are drilled."""

    name: str
    least: int
    most: int
    drilled: bool
    rows: int
    base: float
    even: bool = False
    row_size: int | None = None
    balance: float | None = None
    spread: float | None = None
    pitch_least: float | None = None
    pitch_most: float | None = None


# The known packages, and what each met demand adds to the base score.
SIGNATURES = (
    Signature("TWO_PIN_THT", 2, 2, True, 1, 0.45, pitch_most=25.0),
    Signature("TWO_PAD_SMD", 2, 2, False, 1, 0.45, pitch_most=15.0),
    Signature("DIP8_LIKE", 8, 8, True, 2, 0.45, row_size=4, balance=0.95, spread=0.08, pitch_least=0.3, pitch_most=5.0),
    Signature("SOIC8_LIKE", 8, 8, False, 2, 0.45, row_size=4, balance=0.95, spread=0.08, pitch_least=0.3, pitch_most=5.0),
    Signature("SINGLE_ROW_THT", 3, 40, True, 1, 0.1, spread=0.15, pitch_least=0.3, pitch_most=10.0),
    Signature("SINGLE_ROW_SMD", 3, 40, False, 1, 0.1, spread=0.15, pitch_least=0.3, pitch_most=10.0),
    Signature("DUAL_ROW_THT", 4, 40, True, 2, 0.1, even=True, balance=0.8, spread=0.15, pitch_least=0.3, pitch_most=10.0),
    Signature("DUAL_ROW_SMD", 4, 40, False, 2, 0.1, even=True, balance=0.8, spread=0.15, pitch_least=0.3, pitch_most=10.0),
)
GAIN = {"count": 0.1, "drilled": 0.2, "rows": 0.2, "row_size": 0.1, "balance": 0.1, "spread": 0.1, "pitch_least": 0.05, "pitch_most": 0.05}
LEAST_SCORE, LEAST_MARGIN = 0.7, 0.08


def rows_of(along: np.ndarray, across: np.ndarray, tolerance: float) -> list[np.ndarray]:
    """The places along of each row: pads in order across, a new row where one is off the mean of the row so far."""
    rows, mean = [], 0.0
    for k in np.lexsort((along, across)):
        if not rows or abs(across[k] - mean) > tolerance:
            rows.append([k])
        else:
            rows[-1].append(k)
        mean = across[rows[-1]].mean()
    return [np.sort(along[r]) for r in rows]


def features(x: np.ndarray, y: np.ndarray, drilled: np.ndarray) -> dict:
    """Number, drilled share, least pitch, row sizes and how even the pitches are, along the axes of the layout."""
    gap = np.hypot(x[:, None] - x[None, :], y[:, None] - y[None, :])[np.triu_indices(len(x), 1)]
    gap = gap[gap > 1e-9]
    dx, dy = x - x.mean(), y - y.mean()
    turn = 0.5 * math.atan2(2 * (dx * dy).sum(), (dx * dx).sum() - (dy * dy).sum()) if len(x) > 1 else 0.0
    a, b = dx * math.cos(turn) + dy * math.sin(turn), dy * math.cos(turn) - dx * math.sin(turn)
    pitch = float(gap.min()) if len(gap) else None
    tolerance = max(1e-6, 0.2 * (pitch or max(np.ptp(a), np.ptp(b), 1.0)))
    ways = [rows_of(a, b, tolerance), rows_of(b, a, tolerance)]
    rows = min(ways, key=lambda rows: (len(rows), -max(map(len, rows))))
    steps = np.concatenate([np.diff(r) for r in rows])
    steps = steps[steps > 1e-9]
    sizes = [len(r) for r in rows]
    return {"count": len(x), "drilled": drilled.mean(), "pitch": pitch, "sizes": sizes, "balance": min(sizes) / max(sizes), "spread": float(steps.std() / steps.mean()) if len(steps) and steps.mean() > 1e-12 else None}


def score(f: dict, s: Signature) -> float:
    """0 where a demand isn't met, else the base and what each demand adds, 1 at most."""
    asked = [
        ("count", s.least == s.most, s.least <= f["count"] <= s.most and not (s.even and f["count"] % 2)), ("drilled", True, f["drilled"] >= 0.99 if s.drilled else f["drilled"] <= 0.01), ("rows", True, len(f["sizes"]) == s.rows),
        ("row_size", s.row_size is not None, s.row_size is None or set(f["sizes"]) == {s.row_size}), ("balance", s.balance is not None, s.balance is None or f["balance"] >= s.balance),
        ("spread", s.spread is not None, s.spread is None or f["spread"] is not None and f["spread"] <= s.spread),
        ("pitch_least", s.pitch_least is not None, s.pitch_least is None or f["pitch"] is not None and f["pitch"] >= s.pitch_least), ("pitch_most", s.pitch_most is not None, s.pitch_most is None or f["pitch"] is not None and f["pitch"] <= s.pitch_most),
    ]
    if not all(met for *_, met in asked):
        return 0.0
    total = s.base
    for name, adds, _ in asked:
        total += GAIN[name] if adds else 0.0
    return max(0.0, min(1.0, total))


def match(x, y, drilled, signatures: tuple[Signature, ...] = SIGNATURES) -> tuple[str | None, str, float, float, str]:
    """(hint, best candidate, its score, margin to the next, state): accepted, ambiguous or weak."""
    f = features(np.asarray(x, dtype=float), np.asarray(y, dtype=float), np.asarray(drilled, dtype=bool))
    ranked = sorted(((score(f, s), s.name) for s in signatures), key=lambda r: (-r[0], r[1]))
    (top, name), after = ranked[0], ranked[1][0] if len(ranked) > 1 else 0.0
    state = "weak" if top < LEAST_SCORE else "ambiguous" if after > 0 and top - after < LEAST_MARGIN else "accepted"
    return name if state == "accepted" else None, name, top, top - after, state


def package_hints(members: DataFrame, signatures: tuple[Signature, ...] = SIGNATURES) -> DataFrame:
    """(component_id, package_hint, candidate, score, margin, state) from the pads of components (component_id, x, y, drill).

    No package has more pads than the largest signature asks for, so the pads of larger components are counted but
    never gathered.
    """
    most = max(s.most for s in signatures)
    own = members.select("component_id", "x", "y", "drill")
    kind = members.schema["component_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pads = [np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False)) for c in ("x", "y", "drilled")]
            ends = np.cumsum(batch.column("x").value_lengths().to_numpy(zero_copy_only=False).astype(int))
            told = [match(*(v[i:j] for v in pads), signatures) for i, j in zip([0, *ends], ends, strict=False)]
            kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("component_id"), *[pa.array([t[k] for t in told], v) for k, v in enumerate(kinds)]], names=["component_id", "package_hint", "candidate", "score", "margin", "state"])

    # counted where they are grouped, so that nothing is broadcast; a window spills what it can't hold
    small = own.withColumn("n", F.count("*").over(Window.partitionBy("component_id"))).where(F.col("n") <= most).drop("n")
    small = small.where("component_id is not null")
    listed = lambda of: F.transform("pads", lambda p: of(p))
    rows = small.groupBy("component_id").agg(F.collect_list(F.struct("x", "y", "drill")).alias("pads"))
    told = rows.select("component_id", listed(lambda p: p["x"].cast("double")).alias("x"), listed(lambda p: p["y"].cast("double")).alias("y"), listed(lambda p: p["drill"].isNotNull()).alias("drilled")).mapInArrow(run, f"component_id {kind}, package_hint string, candidate string, score double, margin double, state string")
    none = F.lit(None).cast("string")
    large = own.groupBy("component_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("component_id", none.alias("package_hint"), none.alias("candidate"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"), F.lit("weak").alias("state"))
    return told.unionByName(large)
