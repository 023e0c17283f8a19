"""Causal state machines of the online operators. Plain Python: no pandas, no Spark, all state is JSON-able.

Each machine is a class with ``step(row) -> dict`` and ``state`` / ``restore`` for snapshots, so that the same code runs
in a grouped backfill and in a streaming job (see ``hosts``). A step sees its row and its own past, never a later row.
"""

from __future__ import annotations

import copy
import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence
from operator import mul

import numpy as np

from strandline.functions.linear import distances, middle_and_scale, precision, unit


class Machine:
    """Snapshots by deep copy of the instance dictionary."""

    def state(self) -> dict:
        return copy.deepcopy(self.__dict__)

    def restore(self, state: dict) -> None:
        self.__dict__.update(copy.deepcopy(state))


def middle(values: Sequence[float]) -> float:
    return float(np.median(values)) if len(values) else math.nan


def spread(values: Sequence[float], floor: float = 1e-9) -> float:
    x = np.asarray(values, float)
    return max(1.4826 * float(np.median(np.abs(x - np.median(x)))), floor) if len(x) else floor


def sorted_middle(v: Sequence[float]) -> float:
    """The median of sorted values."""
    h = len(v) // 2
    return v[h] if len(v) % 2 else (v[h - 1] + v[h]) / 2


def median_of(values: Sequence[float]) -> float:
    """The median of a few values: sorting them costs less than an array of them; NaN if one is missing."""
    total = sum(values)
    return float(np.median(values)) if total != total else float(sorted_middle(sorted(values)))


def dot(a: Sequence[float], b: Sequence[float]) -> float:
    return sum(map(mul, a, b))


def length_of(v: Sequence[float]) -> float:
    return math.sqrt(sum(map(mul, v, v)))


def unit_of(v: Sequence[float], eps: float = 1e-9) -> list[float] | None:
    size = length_of(v)
    return [x / size for x in v] if size > eps else None


def filled(v: Sequence[float | None]) -> list[float]:
    """Missing components as NaN."""
    return [math.nan if x is None else x for x in v] if None in v else list(v)


def sorted_deviation(v: Sequence[float], mid: float) -> float:
    """The median of the distances of sorted values from ``mid``: the nearest half of them is a stretch, found by halving."""
    n = len(v)
    k = n // 2 + n % 2
    lo, hi = 0, n - k
    while lo < hi:
        at = (lo + hi) // 2
        if mid - v[at] > v[at + k] - mid:
            lo = at + 1
        else:
            hi = at
    far = max(mid - v[lo], v[lo + k - 1] - mid)
    if n % 2:
        return far
    return (far + min(abs(mid - v[i]) for i in (lo - 1, lo + k) if 0 <= i < n)) / 2


class Evidence(Machine):
    """Accumulates valid cycles of a condition; guarded rows pause it, a long failure resets it, confirmation latches."""

    def __init__(self, stride: float = 5.0, candidate: float = 300.0, confirm: float = 500.0, forgive: float = 150.0):
        self.stride, self.candidate, self.confirm, self.forgive = stride, candidate, confirm, forgive
        self.success = self.failure = 0.0
        self.phase = "searching"

    def step(self, row: dict) -> dict:
        if not row.get("guard") and self.phase != "confirmed":
            if row["condition"]:
                self.success, self.failure = self.success + self.stride, 0.0
                if self.success >= self.confirm:
                    self.phase = "confirmed"
                elif self.success >= self.candidate:
                    self.phase = "candidate"
            else:
                self.failure += self.stride
                if self.failure >= self.forgive:
                    self.success = self.failure = 0.0
                    self.phase = "searching"
        return {"success": self.success, "failure": self.failure, "phase": self.phase}


#: Freeze reasons by rising priority. Fixed values.
PRIORITY = {"SUSTAINED_RS": 1, "HIGH_AWR_HIGH_BD": 2, "TES_EVENT": 3, "HIGH_RISK": 4}


def suppressed_rise(score: Sequence[float], distance: Sequence[float], slow: Sequence[float], drop: float) -> bool:
    """Score and distance both rise (fitted lines) while slow risk fell from its highest by more than ``drop``."""
    if not max(slow) - slow[-1] > drop:
        return False
    t = np.arange(len(score)) - (len(score) - 1) / 2
    return bool(t @ np.asarray(score) > 0 and t @ np.asarray(distance) > 0)


class FreezeMachine(Machine):
    """Adapter states: calibration, restart guard, frozen by risk or by an event, cooldown, monitoring, active update.

    A freeze lasts through its last window. While it lasts, a reason of higher priority takes it over, and any reason
    that would end at least ``extend`` windows later prolongs it under the reason that it has.

    Rows may bring ``delta``, what an update adds to the adapted value, with ``awr``, ``bd`` and ``slow``: every ``every`` windows
    of active update the value moves by it, within +-1. ``lookback`` windows after the first update that follows a
    checkpoint, and once for each last update, the value is set back to the checkpoint's and cools down for ``cooldown``
    windows, if score and distance have risen while slow risk fell. Checkpoints are taken every ``checkpoint`` windows.
    """

    def __init__(self, freeze: int = 100, safe: int = 10, calibration: float = 500.0, extend: int = 20, cooldown: int = 200, checkpoint: int = 200, lookback: int = 50, drop: float = 0.15, every: int = 20):
        self.freeze, self.safe, self.calibration, self.extend, self.cooldown = freeze, safe, calibration, extend, cooldown
        self.checkpoint, self.lookback, self.drop, self.every = checkpoint, lookback, drop, every
        self.mode, self.until, self.reason, self.run = "CALIBRATION", -1, "", 0
        self.value, self.saved, self.updated, self.judged = 0.0, None, None, None
        self.past: list[list[float]] = []

    def request(self, index: int, reason: str) -> str:
        """The event that the request leads to, or none."""
        end, active = index + self.freeze, index <= self.until
        stronger = PRIORITY[reason] > PRIORITY.get(self.reason, 0)
        if active and not stronger and end < self.until + self.extend:
            return ""
        self.until = max(end, self.until) if active else end
        if stronger or not active:
            self.reason, self.mode = reason, "FROZEN_RISK" if reason == "HIGH_RISK" else "FROZEN_EVENT"
        return "EXTEND_FREEZE" if active else "ENTER_STATE"

    def _adapt(self, row: dict, index: int) -> str:
        """Update, rollback and checkpoint of a window, in this order."""
        self.past.append([row["awr"], row["bd"], row["slow"]])
        del self.past[: -self.lookback]
        event = ""
        if self.mode == "ACTIVE_UPDATE" and index % self.every == 0:
            self.value, self.updated, event = max(-1.0, min(1.0, self.value + row["delta"])), index, "UPDATE"
        due = self.saved is not None and self.updated is not None and self.updated > self.saved[0] and index >= self.updated + self.lookback
        if due and self.judged != self.updated:
            self.judged = self.updated
            if len(self.past) == self.lookback and suppressed_rise(*zip(*self.past, strict=True), self.drop):
                self.value, self.until, self.mode, event = self.saved[1], index + self.cooldown, "COOLDOWN", "ROLLBACK"
        if index and index % self.checkpoint == 0:
            self.saved, event = [index, self.value], event or "CHECKPOINT"
        return event

    def step(self, row: dict) -> dict:
        index, calm, guard, event = row["window_index"], row["end_cycle"] <= self.calibration, bool(row.get("guard")), ""
        if not calm and not guard:
            for reason, flag in (("HIGH_RISK", "high_risk"), ("TES_EVENT", "tes"), ("HIGH_AWR_HIGH_BD", "high_pair"), ("SUSTAINED_RS", "sustained_rs")):
                if row.get(flag):
                    event = self.request(index, reason)
                    break
        if calm or guard:
            self.mode, self.run = "CALIBRATION" if calm else "RESTART_GUARD", 0
        elif index <= self.until:
            self.run = 0
        else:
            if self.mode.startswith("FROZEN") or self.mode == "COOLDOWN":
                event, self.reason = "EXIT_FREEZE", ""
            self.run = self.run + 1 if row.get("safe", True) else 0
            self.mode = "ACTIVE_UPDATE" if self.run >= self.safe else "ACTIVE_MONITOR"
        if row.get("delta") is not None:
            event = self._adapt(row, index) or event
        return {"mode": self.mode, "freeze_until": self.until, "reason": self.reason, "safe_run": self.run, "event": event, "value": self.value}


class SlowRisk(Machine):
    """Asymmetric moving average of a probability: up fast, down slowly."""

    def __init__(self, up: float = 0.15, down: float = 0.02):
        self.up, self.down, self.value = up, down, 0.0

    def step(self, row: dict) -> dict:
        self.value += (self.up if row["p"] > self.value else self.down) * (row["p"] - self.value)
        return {"slow_risk": self.value}


class Reliability(Machine):
    """Falls at once with noise and saturation, recovers slowly, never below a floor."""

    def __init__(self, down: float = 0.02, up: float = 0.01, floor: float = 0.5):
        self.down, self.up, self.floor, self.value = down, up, floor, 1.0

    def step(self, row: dict) -> dict:
        target = row["evidence"]
        self.value = max(self.floor, target, self.value - self.down) if target < self.value else min(1.0, target, self.value + self.up)
        return {"reliability": self.value}


class GatedAdapter(Machine):
    """A score of features weighed by their reliability, and a logit offset, both learned in safe windows only.

    Rows bring the features ``x``, their baseline deviations ``mad0``, ``bd``, ``rs50`` and ``tes``, and the limits ``awr95``, ``bd95``
    and ``tes_limit``. A feature's evidence falls with the noise of its last ``window`` values against the baseline, with
    their saturation and with missing ones. Lower evidence counts at once, at any time after calibration; recovery waits
    for an open gate and is slow. The offset starts from the calibration's logits.

    The gate is open outside calibration, freezes, high risk, high score or distance, rising trends, events (now or within
    ``gate`` windows) and common saturation. Freezes last ``freeze`` windows from the strongest of: high risk, event,
    three windows of rising trend, high score with high distance. Checkpoints and rollbacks are those of the adapter's
    states: an update since the last checkpoint is undone when score and distance rise while slow risk falls.
    """

    def __init__(self, head: Sequence[float] = (-2.0, 1.0, 0.0), target: float = 0.05, rate: float = 0.005, every: int = 20, most: float = 1.0, slow: float = 0.25, risk: float = 0.6, checkpoint: int = 200, freeze: int = 100, cooldown: int = 200, lookback: int = 50, window: int = 50, gate: int = 20, ewma: float = 0.05, least: float = 0.25, saturated: float = 11.9, rising: float = 0.005, calibration: float = 500.0, drop: float = 0.15):
        self.head, self.target, self.rate, self.every, self.most, self.slow_limit, self.risk = list(head), target, rate, every, most, slow, risk
        self.checkpoint, self.freeze, self.cooldown, self.lookback, self.window, self.gate = checkpoint, freeze, cooldown, lookback, window, gate
        self.ewma, self.least, self.saturated, self.rising, self.calibration, self.drop = ewma, least, saturated, rising, calibration, drop
        self.reliability, self.history, self.ordered, self.past = None, [], [], []
        self.offset, self.noise, self.slow, self.frozen, self.run = 0.0, 1.0, 0.0, 0, 0
        self.saved, self.updated, self.first_logits = None, None, []
        self.events: list[int] = []
        self.highs: list[int] = []

    def _evidence(self, mad0: Sequence[float]) -> tuple[np.ndarray, np.ndarray, float]:
        """(evidence of each feature, noise ratios, mean saturation) of the last values."""
        raw, ratios, shares, n = [], [], [], len(self.history)
        for seen, base in zip(self.ordered, mad0, strict=True):
            recent = max(1.4826 * sorted_deviation(seen, sorted_middle(seen)), 1e-9) if seen else base
            share = (bisect_right(seen, -self.saturated) + len(seen) - bisect_left(seen, self.saturated)) / len(seen) if seen else 0.0
            ratio = recent / max(base, 1e-9)
            raw.append(min(1.0, max(self.least, math.exp(-0.5 * max(ratio - 1, 0.0)) * (1 - 0.8 * share) * len(seen) / n)))
            ratios.append(ratio)
            shares.append(share)
        return np.array(raw), np.array(ratios), float(np.mean(shares))

    def _push(self, x: list[float]) -> None:
        """The newest values come in and the oldest go; the finite ones of each feature are kept sorted, too."""
        self.history.append(x)
        self.ordered = self.ordered or [[] for _ in x]
        gone = self.history.pop(0) if len(self.history) > self.window else [math.nan] * len(x)
        for seen, new, old in zip(self.ordered, x, gone, strict=True):
            if math.isfinite(old):
                del seen[bisect_left(seen, old)]
            if math.isfinite(new):
                insort(seen, new)

    def _blocked(self, row: dict, awr: float, saturation: float, index: int) -> str:
        """The first reason why nothing may be learned, or none."""
        near = lambda at: any(index - self.gate <= k < index for k in at)
        reasons = (
            ("calibration_phase", row["end_cycle"] <= self.calibration), ("forced_freeze", self.frozen > 0), ("slow_risk", self.slow >= self.slow_limit), ("awr_calibration_p95", awr >= row["awr95"]), ("bd_calibration_p95", row["bd"] >= row["bd95"]),
            ("rs50_positive", row["rs50"] is None or row["rs50"] > 0), ("tes_threshold", row["tes"] >= row["tes_limit"]), ("recent_tes_event", near(self.events)), ("recent_high_risk", near(self.highs)), ("saturation_feature_rate", saturation >= 0.30),
        )
        return next((name for name, holds in reasons if holds), "")

    def step(self, row: dict) -> dict:
        index, calm, x = row["window_index"], row["end_cycle"] <= self.calibration, np.array([math.nan if v is None else v for v in row["x"]], float)
        self._push(x.tolist())
        trust = np.ones(len(x)) if self.reliability is None else np.array(self.reliability)
        raw, ratios, saturation = self._evidence(row["mad0"])
        if not calm:
            trust = np.minimum(trust, raw)
        use = np.isfinite(x)
        awr = float(trust[use] @ x[use] / trust[use].sum()) if use.any() else 0.0
        logit = self.head[0] + self.head[1] * awr + self.head[2] * row["bd"]
        wanted = math.log(self.target / (1 - self.target))
        if calm:
            self.first_logits.append(logit)
        elif self.first_logits:
            self.offset, self.first_logits = max(-self.most, min(self.most, wanted - float(np.median(self.first_logits)))), []
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, logit + self.offset))))
        self.slow += (0.15 if p > self.slow else 0.02) * (p - self.slow)
        high, event_now = p >= self.risk, row["tes"] >= row["tes_limit"]
        self.run = self.run + 1 if row["rs50"] is not None and row["rs50"] > self.rising else 0
        event = ""
        if not calm:
            event = "HIGH_RISK" if high else "TES_EVENT" if event_now else "SUSTAINED_RS" if self.run >= 3 else "HIGH_AWR_HIGH_BD" if awr >= row["awr95"] and row["bd"] >= row["bd95"] else ""
            if event:
                self.frozen = max(self.frozen, self.freeze)
        blocked = self._blocked(row, awr, saturation, index)
        self.frozen = max(0, self.frozen - 1)
        if not blocked:
            trust = np.clip((1 - self.ewma) * trust + self.ewma * raw, self.least, 1.0)
            self.noise = 0.95 * self.noise + 0.05 * float(np.median(ratios))
            if index % self.every == 0:
                q = min(1 - 1e-9, max(1e-9, p))
                self.offset = max(-self.most, min(self.most, self.offset + self.rate * (wanted - math.log(q / (1 - q)))))
            self.updated = index
        self.reliability = trust.tolist()
        self.past.append([awr, row["bd"], self.slow])
        del self.past[: -self.lookback]
        if self.saved and self.updated is not None and self.updated > self.saved["at"] and len(self.past) == self.lookback and suppressed_rise(*zip(*self.past, strict=True), self.drop):
            self.reliability, self.offset, self.noise = list(self.saved["reliability"]), self.saved["offset"], self.saved["noise"]
            self.frozen, event = max(self.frozen, self.cooldown), "ROLLBACK"
        if index and index % self.checkpoint == 0:
            self.saved = {"at": index, "reliability": list(self.reliability), "offset": self.offset, "noise": self.noise}
            event = event or "CHECKPOINT"
        for seen, holds in ((self.events, event_now), (self.highs, high)):
            if holds:
                seen.append(index)
            while seen and seen[0] < index - self.gate:
                del seen[0]
        return {"awr": awr, "probability": p, "slow_risk": self.slow, "offset": self.offset, "noise": self.noise, "frozen": self.frozen, "gate": int(not blocked), "reason": blocked, "event": event, "reliability": self.reliability}


class NuisanceAdapter(Machine):
    """Learns slow drift orthogonal to protected axes; a replay of baseline rows vetoes updates that move the score."""

    def __init__(self, axes: list[list[float]], rate: float = 0.002, clip: float = 3.0, drift: float = 0.10, keep: int = 50):
        q, _ = np.linalg.qr(np.asarray(axes, float).T)
        self.q, self.rate, self.clip, self.drift, self.keep = q.tolist(), rate, clip, drift, keep
        self.beta = [0.0] * len(axes[0])
        self.replay: list[list[float]] = []

    def step(self, row: dict) -> dict:
        x, q, beta = np.asarray(row["x"], float), np.asarray(self.q), np.asarray(self.beta)
        score = float((x - beta) @ q[:, 0])
        reason = "RESTART_GUARD" if row.get("guard") else "HIGH_OOS" if row.get("oos", 0.0) > 0.35 else "HIGH_TES" if row.get("tes") else "MISSING_DATA" if np.isnan(x).any() else ""
        if row["end_cycle"] <= 500 and len(self.replay) < self.keep and not reason:
            self.replay.append(x.tolist())
        if not reason:
            residual = np.clip(x - q @ (q.T @ x), -self.clip, self.clip)
            new = (1 - self.rate) * beta + self.rate * residual
            back = np.asarray(self.replay, float)
            moved = abs(np.median((back - new) @ q[:, 0]) - np.median((back - beta) @ q[:, 0])) if len(back) else 0.0
            if moved > self.drift:
                self.rate, reason = max(self.rate / 2, 5e-5), "REPLAY_DRIFT"
            else:
                self.beta, reason = new.tolist(), "ACCEPTED"
        return {"score": score, "beta_norm": float(np.linalg.norm(self.beta)), "reason": reason}


class Recursive(Machine):
    """Recursive least squares with forgetting from given weights, a clipped residual and a bounded gain."""

    def __init__(self, start: Sequence[float], forget: float = 0.999, cov: float = 100.0, gain: float = 0.10):
        self.start, self.forget, self.cov, self.gain = list(start), forget, cov, gain
        self.reset()

    def reset(self) -> None:
        """Back to the weights that it began with."""
        self.theta, self.p = list(self.start), (self.cov * np.eye(len(self.start))).tolist()

    def predict(self, x: Sequence[float]) -> float:
        return float(np.dot(self.theta, x))

    def update(self, x: Sequence[float], y: float, limit: float) -> None:
        v, p = np.asarray(x, float), np.asarray(self.p)
        pv = p @ v
        gain = pv / max(self.forget + float(v @ pv), 1e-12)
        size = float(np.sqrt(gain @ gain))
        if size > self.gain:
            gain *= self.gain / size
        error = y - float(np.dot(self.theta, v))
        self.theta = (np.asarray(self.theta) + gain * max(-limit, min(limit, error))).tolist()
        self.p = ((p - np.outer(gain, v @ p)) / self.forget).tolist()


class SharedRecursive(Machine):
    """Recursive least squares of several outputs that share one covariance: a row of weights for each output."""

    def __init__(self, start: Sequence[Sequence[float]], forget: float = 0.995, cov: float = 100.0):
        self.forget, self.theta = forget, [list(w) for w in start]
        self.p = (cov * np.eye(len(self.theta[0]))).tolist()

    def predict(self, x: Sequence[float]) -> list[float]:
        return (np.asarray(self.theta) @ np.asarray(x, float)).tolist()

    def update(self, x: Sequence[float], y: Sequence[float]) -> None:
        v, p, theta = np.asarray(x, float), np.asarray(self.p), np.asarray(self.theta)
        pv = p @ v
        gain = pv / (self.forget + float(v @ pv))
        self.theta = (theta + np.outer(np.asarray(y, float) - theta @ v, gain)).tolist()
        self.p = ((p - np.outer(gain, v @ p)) / self.forget).tolist()


class Kalman(Machine):
    """Local level and trend. The first observation is the level."""

    def __init__(self, noise: float = 1e-3, level: float = 1e-4, trend: float = 1e-7):
        self.noise, self.level_noise, self.trend_noise = noise, level, trend
        self.x, self.p, self.at = [0.0, 0.0], [[1.0, 0.0], [0.0, 1.0]], None

    def update(self, at: float, y: float) -> None:
        if self.at is None:
            self.x, self.at = [y, 0.0], at
            return
        dt = max(1.0, at - self.at)
        (a, b), (c, d) = self.p
        # one step ahead: F p F' + Q with F = [[1, dt], [0, 1]]
        a, b, d = a + dt * (b + c) + dt * dt * d + self.level_noise * dt * dt, b + dt * d, d + self.trend_noise * dt
        level, trend = self.x[0] + dt * self.x[1], self.x[1]
        g0, g1 = a / (a + self.noise), b / (a + self.noise)
        self.x = [level + g0 * (y - level), trend + g1 * (y - level)]
        self.p, self.at = [[a - g0 * a, b - g0 * b], [b - g1 * a, d - g1 * b]], at

    def trend(self) -> float:
        return self.x[1]


class History(Machine):
    """The last rows of several inputs, and the features of a forecast: one, their means, deviations and changes."""

    def __init__(self, rows: int):
        self.rows, self.past = rows, []

    def push(self, inputs: Sequence[float | None]) -> list[float] | None:
        self.past.append([math.nan if v is None else v for v in inputs])
        if len(self.past) > self.rows:
            del self.past[0]
        x = np.asarray(self.past, float)
        if len(x) < self.rows or not np.isfinite(x).all():
            return None
        return [1.0, *x.mean(axis=0).tolist(), *x.std(axis=0).tolist(), *(x[-1] - x[0]).tolist()]


class Forecaster(Machine):
    """Delayed-feedback forecasts of one output over one horizon: zero change, local linear, Kalman, a frozen head, an
    online one that starts from the frozen weights, and a safe mixture of both.

    Rows bring ``inputs``, the output's ``value``, their ``horizon`` and the ``frozen`` weights (those of a source stream);
    a row without a value or without a full history of finite inputs makes no forecast, nor does a stream without weights.

    A forecast settles when the first row at or after its due cycle arrives; until then no model sees it. Heads are on
    probation until ``ring`` forecasts have settled. One that is worse than the frozen head (1.10 of its mean error, or
    1.20 of its root mean square) is set back to the frozen weights and frozen for ``freeze`` cycles; a freeze is never
    prolonged, and ends in a new probation. A better one gains weight in steps of ``gain``.
    """

    def __init__(self, history: int = 20, ring: int = 200, freeze: float = 500.0, slope_rows: int = 10, gain: float = 0.05):
        self.ring, self.freeze, self.slope_rows, self.gain = ring, freeze, slope_rows, gain
        self.history, self.kalman, self.online = History(history), Kalman(), None
        self.recent: list[list[float]] = []
        self.waiting: list[dict] = []
        self.scores: list[list[float]] = []
        self.alpha, self.mode, self.thaw, self.episode = 0.0, "PROBATION", -math.inf, 0

    def _settle(self, at: float, y: float, guard: bool) -> int:
        settled = 0
        while self.waiting and self.waiting[0]["due"] <= at:
            w = self.waiting.pop(0)
            settled += 1
            change = y - w["value"]
            self.scores.append([abs(w["frozen"] - change), abs(w["online"] - change)])
            if len(self.scores) > self.ring:
                del self.scores[0]
            if self.mode != "FROZEN" and not w["guard"] and not guard:
                self.online.update(w["x"], change, 3 * spread([e[1] for e in self.scores], 1e-9))
            if len(self.scores) == self.ring and self.mode != "FROZEN":
                self._judge(at)
        return settled

    def _judge(self, at: float) -> None:
        errors = np.asarray(self.scores)
        (frozen, online), (frozen2, online2) = np.maximum(errors.mean(0), 1e-9), np.maximum(np.sqrt((errors**2).mean(0)), 1e-9)
        if online > 1.10 * frozen or online2 > 1.20 * frozen2:
            self.mode, self.thaw, self.alpha, self.episode = "FROZEN", at + self.freeze, 0.0, self.episode + 1
            self.online.reset()
        elif self.mode == "PROBATION":
            self.mode, self.alpha = "ACTIVE", 0.0
        elif online <= 0.95 * frozen and online2 <= 1.05 * frozen2:
            self.alpha = min(1.0, self.alpha + self.gain)

    def _slope(self) -> float:
        if len(self.recent) < 3:
            return 0.0
        x = np.asarray(self.recent)
        return float(np.median(np.diff(x[:, 1]) / np.maximum(np.diff(x[:, 0]), 1e-9)))

    def step(self, row: dict) -> dict:
        at, y, guard, horizon = row["center_cycle"], row["value"], bool(row.get("guard")), row["horizon"]
        if self.mode == "FROZEN" and at >= self.thaw:
            self.mode, self.alpha, self.scores = "PROBATION", 0.0, []
        if self.online is None and row.get("frozen"):
            self.online = Recursive(row["frozen"])
        settled = self._settle(at, y, guard) if y is not None else 0
        x = self.history.push(row["inputs"])
        out = {"zero": None, "linear": None, "kalman": None, "frozen": None, "online": None, "safe": None, "alpha": self.alpha, "mode": self.mode, "episode": self.episode, "settled": settled}
        if y is None:
            return out
        self.kalman.update(at, y)
        if not guard:
            self.recent.append([at, y])
            del self.recent[: -self.slope_rows]
        if x is not None and self.online is not None:
            frozen, online = float(np.dot(row["frozen"], x)), self.online.predict(x)
            safe = (1 - self.alpha) * frozen + self.alpha * online
            out |= {"zero": y, "linear": y + horizon * self._slope(), "kalman": y + horizon * self.kalman.trend(), "frozen": y + frozen, "online": y + online, "safe": y + safe}
            self.waiting.append({"due": at + horizon, "value": y, "x": x, "frozen": frozen, "online": online, "guard": guard})
        return out


class SharedForecaster(Machine):
    """Delayed-feedback forecasts of several outputs over one horizon by one recursive fit with a shared covariance.

    Rows bring ``inputs``, ``values`` (one for each output), their ``horizon`` and ``frozen`` (weights of each output).
    """

    def __init__(self, history: int = 20):
        self.history, self.online, self.waiting = History(history), None, []

    def step(self, row: dict) -> dict:
        at, y = row["center_cycle"], row["values"]
        if self.online is None and row.get("frozen"):
            self.online = SharedRecursive(row["frozen"])
        settled, whole = 0, all(v is not None for v in y)
        while whole and self.waiting and self.waiting[0]["due"] <= at:
            w = self.waiting.pop(0)
            self.online.update(w["x"], [b - a for a, b in zip(w["values"], y, strict=True)])
            settled += 1
        x = self.history.push(row["inputs"])
        out = {"frozen": None, "online": None, "settled": settled}
        if x is not None and whole and self.online is not None:
            frozen, online = (np.asarray(row["frozen"]) @ np.asarray(x)).tolist(), self.online.predict(x)
            out |= {k: [a + b for a, b in zip(y, v, strict=True)] for k, v in (("frozen", frozen), ("online", online))}
            self.waiting.append({"due": at + row["horizon"], "values": y, "x": x})
        return out


class ForwardFilter(Machine):
    """Forward filter over ordered states with a tri-diagonal transition."""

    def __init__(self, states: int = 5, stay: float = 0.97, forward: float = 0.025, back: float = 0.005):
        t = np.zeros((states, states))
        for i in range(states):
            t[i, i] = stay
            if i + 1 < states:
                t[i, i + 1] = forward
            if i:
                t[i, i - 1] = back
        self.t, self.q = (t / t.sum(1, keepdims=True)).tolist(), [1.0, *[0.0] * (states - 1)]

    def step(self, row: dict) -> dict:
        q = np.asarray(row["observation"], float) * (np.asarray(self.q) @ np.asarray(self.t))
        total = q.sum()
        self.q = (q / total).tolist() if total > 0 else self.q
        top = sorted(self.q, reverse=True)
        return {"posterior": self.q, "stage": int(np.argmax(self.q)) + 1, "margin": top[0] - top[1]}


class ElapsedEvidence(Machine):
    """Evidence by elapsed cycles: a run of rows that meet a condition, which a guard or a failure breaks."""

    def __init__(self, candidate: float = 300.0, confirm: float = 500.0):
        self.candidate, self.confirm, self.since, self.success = candidate, confirm, None, 0.0
        self.phase = "searching"

    def step(self, row: dict) -> dict:
        if self.phase != "confirmed":
            if row["condition"] and not row.get("guard"):
                self.since = row["at"] if self.since is None else self.since
                self.success = row["at"] - self.since
                self.phase = "confirmed" if self.success >= self.confirm else "candidate" if self.success >= self.candidate else "searching"
            else:
                self.since, self.success, self.phase = None, 0.0, "searching"
        return {"success": self.success, "failure": 0.0, "phase": self.phase}


class PlateauEngine(Machine):
    """Plateau lock, exit and severity of a stream of feature vectors, under the limits of a source stream.

    Rows bring the vector ``r`` relative to the baseline, its distance ``d``, the velocities ``v20``, ``v50``, ``v100`` (vectors),
    the volatility ``vol``, the share ``oos`` outside the source's support, and ``prior``: the limits d95, v50, v100 and vol.

    A plateau locks on confirmed evidence of distant but slow rows. Its centre, covariance and scales come from the newest
    qualifying rows of ``reference`` valid cycles and never change. Instability against them needs confirmed evidence of its
    own to count as an exit. After it a direction is learned, by unguarded, consistent, fast and supported rows only: a
    moving average of where the last hundred unguarded rows lie from the plateau, each near the one before. ``severe`` may
    bring the source's direction. The severe score is measured along it, and confirmed like the others.

    ``elapsed`` counts elapsed cycles, broken by guards, in place of valid cycles, which guards pause.
    """

    def __init__(self, least_cycle: float = 2000.0, stride: float = 5.0, reference: float = 500.0, limit: float = 2.0, eta: float = 0.01, consistent: float = 0.60, near: float = 0.70, most_oos: float = 0.35, elapsed: bool = False):
        self.least_cycle, self.stride, self.keep = least_cycle, stride, max(1, math.ceil(reference / stride))
        self.limit, self.eta, self.consistent, self.near, self.most_oos = limit, eta, consistent, near, most_oos
        self.plateau, self.exit, self.severe = ((ElapsedEvidence() if elapsed else Evidence(stride)) for _ in range(3))
        self.qualifying: list[list] = []
        self.unguarded: list[list[float]] = []
        self.accelerations: list[float] = []
        self.scores: list[float] = []
        self.reference: dict | None = None
        self.direction: list[float] | None = None
        self.began = False
        self.locked_at = self.exit_at = self.severe_at = None

    def _lock(self, at: float) -> None:
        r = np.array([q[0] for q in self.qualifying])
        centre, inverse = np.median(r, axis=0), precision(r)
        scales = {"d": middle_and_scale(distances(r, centre, inverse)), "v": middle_and_scale([q[1] for q in self.qualifying]), "a": middle_and_scale([q[2] for q in self.qualifying])}
        spread_ = max(float(np.median(np.linalg.norm(r - centre, axis=1))), 1e-9)
        self.reference = {"centre": centre.tolist(), "inverse": inverse.tolist(), "p": [0.0, spread_], **{k: list(v) for k, v in scales.items()}}
        self.locked_at, self.qualifying = at, []

    def _learn(self, row: dict, cosine: float, fast: float) -> str:
        """Why the direction stays as it is, or UPDATED."""
        if row.get("guard"):
            return "RESTART_GUARD"
        if cosine < self.consistent:
            return "INCONSISTENT"
        if fast < row["prior"]["v50"]:
            return "SLOW"
        if row.get("oos", 0.0) > self.most_oos:
            return "UNSUPPORTED"
        new = unit_of([median_of(c) - x for c, x in zip(zip(*self.unguarded, strict=True), self.reference["centre"], strict=True)])
        if new is None:
            return "ZERO"
        if self.direction is not None:
            if dot(new, self.direction) < self.near:
                return "TURNED"
            new = unit_of([(1 - self.eta) * x + self.eta * y for x, y in zip(self.direction, new, strict=True)])
        self.direction = new
        return "UPDATED"

    def step(self, row: dict) -> dict:
        at, guard, prior = row["center_cycle"], bool(row.get("guard")), row["prior"]
        if not self.began:
            self.began, self.direction = True, row.get("severe")
        r, v20, v50, v100 = filled(row["r"]), filled(row["v20"]), filled(row["v50"]), filled(row["v100"])
        n20, n50, n100 = length_of(v20), length_of(v50), length_of(v100)
        cosine = dot(v20, v100) / max(n20 * n100, 1e-9)
        self.accelerations.append(n20 - n100)
        del self.accelerations[:-20]
        a20 = median_of(self.accelerations)
        if not guard:
            self.unguarded.append(r)
            del self.unguarded[:-100]
        ok = at >= self.least_cycle and not guard and row["d"] > prior["d95"] and n50 < prior["v50"] and n100 < prior["v100"] and row["vol"] < prior["vol"]
        if self.locked_at is None:
            had = self.plateau.success
            if ok:
                self.qualifying.append([r, n50, a20])
                del self.qualifying[: -self.keep]
            if self.plateau.step({"condition": ok, "guard": guard, "at": at})["phase"] == "confirmed":
                self._lock(at)
            elif had > 0 and self.plateau.success == 0:
                self.qualifying = []
        away = instability = score = None
        event = ""
        if self.reference is not None:
            f = self.reference
            z = lambda k, x: (x - f[k][0]) / f[k][1]
            d = [x - y for x, y in zip(r, f["centre"], strict=True)]
            away = math.sqrt(max(sum(x * dot(d, line) for x, line in zip(d, f["inverse"], strict=True)), 0.0))
            instability = 0.35 * z("d", away) + 0.25 * z("v", n50) + 0.20 * z("a", max(a20, 0.0)) + 0.20 * max(cosine, 0.0)
            if self.exit_at is None and self.exit.step({"condition": instability > self.limit, "guard": guard, "at": at})["phase"] == "confirmed":
                self.exit_at = at
            if self.exit_at is not None:
                event = self._learn(row, cosine, n50)
            if self.direction is not None:
                along = dot(d, self.direction)
                score = 0.50 * z("p", along) + 0.20 * z("d", away) + 0.20 * z("v", n50) + 0.10 * max(cosine, 0.0)
                self.scores.append(score)
                del self.scores[:-50]
        s20, s50 = (median_of(self.scores[-k:]) if self.scores else None for k in (20, 50))
        high = score is not None and s50 > self.limit
        if self.severe_at is None and self.severe.step({"condition": high, "guard": guard, "at": at})["phase"] == "confirmed":
            self.severe_at = at
        return {
            "plateau": self.plateau.phase, "exit": self.exit.phase, "severe": self.severe.phase, "distance": away, "instability": instability, "severe_score": score, "severe_20": s20, "severe_50": s50,
            "event": event, "direction": self.direction if self.exit_at is not None else None, "locked_at": self.locked_at, "exit_at": self.exit_at, "severe_at": self.severe_at,
        }


class RegimeDiscovery(Machine):
    """Monotone regimes: a persistent shift of the level opens a candidate, which is accepted or dropped as a whole."""

    def __init__(self, threshold: float = 3.0, least: int = 20, dwell: int = 40, gap: int = 5, stages: int = 5, memory: int = 300):
        self.threshold, self.least, self.dwell, self.gap, self.stages, self.memory = threshold, least, dwell, gap, stages, memory
        self.stage, self.since, self.missed = 1, 0, 0
        self.rows: list[float] = []
        self.ordered: list[float] | None = []
        self.candidate: list[float] = []
        self.reference: list[float] | None = None

    def _middle_and_spread(self) -> list[float]:
        """Those of the rows; kept until the rows change. Rows with a NaN are not sorted."""
        if self.reference is None:
            if not self.rows:
                self.reference = [math.nan, 1.0]
            elif self.ordered is None:
                self.reference = [middle(self.rows), spread(self.rows, 1e-3)]
            else:
                mid = sorted_middle(self.ordered)
                self.reference = [mid, max(1.4826 * sorted_deviation(self.ordered, mid), 1e-3)]
        return self.reference

    def _push(self, x: float) -> None:
        self.rows.append(x)
        gone = self.rows.pop(0) if len(self.rows) > self.memory else None
        if self.ordered is None or x != x:
            self._sort()
        else:
            if gone is not None:
                del self.ordered[bisect_left(self.ordered, gone)]
            insort(self.ordered, x)
        self.reference = None

    def _sort(self) -> None:
        self.ordered, self.reference = None if any(v != v for v in self.rows) else sorted(self.rows), None

    def step(self, row: dict) -> dict:
        x, event = row["level"], ""
        self.since += 1
        mid, scale = self._middle_and_spread()
        score = abs(x - mid) / scale if self.rows else 0.0
        if not row.get("guard"):
            if self.stage < self.stages and self.since >= self.dwell and score >= self.threshold and x > mid:
                self.candidate, self.missed = [*self.candidate, x], 0
                if len(self.candidate) >= self.least:
                    apart = abs(middle(self.candidate) - mid) >= 1.2 * scale
                    tight = spread(self.candidate, 1e-3) <= 1.25 * max(scale, 1e-3) * 4
                    if apart and tight:
                        self.stage, self.since, self.rows, event = self.stage + 1, 0, self.candidate[-self.memory :], "ACCEPT"
                        self._sort()
                    else:
                        event = "REJECT"
                    self.candidate = []
            else:
                if self.candidate:
                    self.missed += 1
                    if self.missed > self.gap:
                        self.candidate, self.missed, event = [], 0, "DROP"
                if not self.candidate:
                    self._push(x)
        return {"stage": self.stage, "score": score, "candidate": len(self.candidate), "event": event}


class OrderedPrototypes(Machine):
    """Prototypes of ordered states on an axis: adapted by confident rows unless that breaks their order."""

    def __init__(self, centres: list[float], least: float = 0.8, rate: float = 0.01, most: float = 0.05):
        self.centres, self.least, self.rate, self.most = list(centres), least, rate, most

    def step(self, row: dict) -> dict:
        x = row["level"]
        w = np.exp(-0.5 * (np.asarray(self.centres) - x) ** 2)
        p = w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))
        k, event = int(p.argmax()), ""
        if p[k] >= self.least and not row.get("guard"):
            new = list(self.centres)
            new[k] += min(self.most, self.rate * (1 + p[k])) * (x - new[k])
            if all(a < b for a, b in zip(new, new[1:], strict=False)):
                self.centres, event = new, "ADAPT"
            else:
                event = "ORDER"
        return {"stage": k + 1, "confidence": float(p[k]), "event": event}


class PrototypeMemory(Machine):
    """Prototypes of five ordered states, adapted to a target stream by confident rows, with a bounded memory of them.

    Rows bring a vector ``x``, ``tes``, ``guard``, and ``source``: the source stream's ``prototypes`` and ``variances`` (a list for each
    state) and its ``tes99``. The observation of a row is half the source's view and half that of the adapted prototypes;
    a forward filter with a tri-diagonal transition makes the posterior of it. A teacher follows the prototypes slowly.

    A row is accepted if the posterior is confident, teacher and source agree on it, nothing guards, disturbs or freezes
    it and the state moves by one at most. An accepted row moves its state's prototype, unless that breaks the order
    along the source's axis, or takes it too far from where it came from, which freezes the stream. Its state's memory
    keeps it, and gives up the entry that is worst by confidence and distance when it is full.

    Every ``checkpoint`` windows the adapted state is kept with the quality of the last 20 rows; from 100 windows on it is
    restored where entropy has risen, agreement has fallen and the order is lost.
    """

    def __init__(self, confident: float = 0.80, js: float = 0.05, margin: float = 0.20, entropy: float = 1.00, rate: float = 0.01, most: float = 0.05, decay: float = 0.995, keep: int = 200, freeze: int = 100, checkpoint: int = 200):
        self.limits, self.rate, self.most, self.decay, self.keep, self.freeze, self.checkpoint = [confident, js, margin, entropy], rate, most, decay, keep, freeze, checkpoint
        self.filter = ForwardFilter()
        self.prototypes = self.variances = self.teacher = None
        self.support, self.memory = [0] * 5, [[] for _ in range(5)]
        self.was, self.until, self.triggered, self.saved = None, -1, False, None
        self.quality: list[list[float]] = []

    @staticmethod
    def posterior(x: Sequence[float], prototypes, variances) -> list[float]:
        d = [-0.5 * sum([(a - b) * (a - b) / max(v, 1e-5) for a, b, v in zip(x, m, s, strict=True)]) for m, s in zip(prototypes, variances, strict=True)]
        most = max(d)
        p = [math.exp(a - most) for a in d]
        total = sum(p)
        return [a / total for a in p]

    @staticmethod
    def ordered(prototypes, source) -> bool:
        first = np.asarray(source)
        return bool((np.diff(np.asarray(prototypes) @ (first[-1] - first[0])) >= -1e-8).all())

    def _move(self, x: np.ndarray, k: int, confidence: float, source: np.ndarray, index: int) -> str:
        """UPDATED, or why the prototype of state ``k`` stays."""
        new = np.array(self.prototypes)
        rate = min(self.most, self.rate * (1 + confidence))
        new[k] = (1 - rate) * new[k] + rate * x
        if not self.ordered(new, source):
            return "PROTOTYPE_ORDER_REJECT"
        room = float(np.linalg.norm(source[min(k + 1, 4)] - source[max(k - 1, 0)]))
        if room > 0 and float(np.linalg.norm(new[k] - source[k])) > 0.2 * room:
            self.until = max(self.until, index + self.freeze)
            return "PROTOTYPE_DRIFT_FREEZE"
        self.prototypes = new.tolist()
        self.variances[k] = (0.99 * np.array(self.variances[k]) + 0.01 * np.maximum((x - new[k]) ** 2, 1e-5)).tolist()
        self.support[k] += 1
        return "UPDATED"

    def _remember(self, x: np.ndarray, k: int, confidence: float, index: int) -> None:
        bucket = self.memory[k]
        bucket.append([index, confidence, x.tolist()])
        if len(bucket) > self.keep:
            away = np.linalg.norm(np.array([b[2] for b in bucket]) - np.array(self.prototypes[k]), axis=1)
            del bucket[int(np.argmin(np.array([b[1] for b in bucket]) - 0.05 * away))]

    def _guard_quality(self, agree: float, entropy: float, source: np.ndarray, index: int) -> str:
        self.quality.append([agree, entropy])
        del self.quality[:-100]
        event = ""
        if index and index % self.checkpoint == 0:
            self.saved = {"at": index, "quality": np.mean(self.quality[-20:], axis=0).tolist(), **copy.deepcopy({k: getattr(self, k) for k in ("prototypes", "variances", "teacher", "support")})}
            event = "CHECKPOINT"
        if self.saved and index - self.saved["at"] >= 100 and len(self.quality) == 100:
            (now, h), (then, h0) = (sum(c) / 100 for c in zip(*self.quality, strict=True)), self.saved["quality"]
            if h > h0 and now < then and not self.ordered(self.prototypes, source):
                for k in ("prototypes", "variances", "teacher", "support"):
                    setattr(self, k, copy.deepcopy(self.saved[k]))
                self.until, event = index + self.freeze, "ROLLBACK"
        return event

    def step(self, row: dict) -> dict:
        index, guard = row["window_index"], bool(row.get("guard"))
        source, spread_ = ([filled(v) for v in row["source"][c]] for c in ("prototypes", "variances"))
        if self.prototypes is None:
            self.prototypes, self.variances, self.teacher = ([list(v) for v in of] for of in (source, spread_, source))
        x = [0.0 if v is None or not math.isfinite(v) else v for v in row["x"]]
        missing = not all(v is not None and math.isfinite(v) for v in row["x"])
        static, taught = self.posterior(x, source, spread_), self.posterior(x, self.teacher, self.variances)
        made = self.filter.step({"observation": [0.5 * a + 0.5 * b for a, b in zip(static, self.posterior(x, self.prototypes, self.variances), strict=True)]})
        q = made["posterior"]
        confidence = max(q)
        k = q.index(confidence)
        entropy = -sum([p * math.log(min(max(p, 1e-8), 1.0)) for p in q])
        mid = [(a + b) / 2 for a, b in zip(static, taught, strict=True)]
        js = sum([0.5 * sum([p * math.log(max(p / m, 1e-8)) for p, m in zip(view, mid, strict=True)]) for view in (static, taught)]) if min(mid) != 0 else math.nan
        agree, upset = static.index(max(static)) == taught.index(max(taught)), row["tes"] > row["source"]["tes99"]
        least, most_js, gap, most_entropy = self.limits
        checks = (
            ("LOW_CONFIDENCE", confidence >= least), ("DISAGREEMENT", agree), ("HIGH_JS", js <= most_js), ("LOW_MARGIN", made["margin"] >= gap), ("HIGH_ENTROPY", entropy <= most_entropy),
            ("RESTART_GUARD", not guard), ("TES_OUTLIER", not upset), ("MISSING", not missing), ("STATE_JUMP", self.was is None or abs(k - self.was) <= 1), ("FROZEN", index > self.until),
        )
        reason, event = next((name for name, passed in checks if not passed), ""), ""
        if not reason:
            event = self._move(np.array(x), k, confidence, np.array(source), index)
            self._remember(np.array(x), k, confidence, index)
            self.teacher = (self.decay * np.array(self.teacher) + (1 - self.decay) * np.array(self.prototypes)).tolist()
        disturbed = guard or upset
        if disturbed and not self.triggered and index > self.until:
            self.until, event = index + self.freeze, event or "FREEZE"
        self.triggered, self.was = disturbed, k
        event = self._guard_quality(float(agree), entropy, source, index) or event
        drift = math.sqrt(max(sum([(a - b) * (a - b) for a, b in zip(m, s, strict=True)]) for m, s in zip(self.prototypes, source, strict=True)))
        return {"stage": k + 1, "confidence": confidence, "entropy": entropy, "margin": made["margin"], "js": js, "reason": reason, "event": event, "support": sum(self.support), "remembered": sum(map(len, self.memory)), "drift": drift}
