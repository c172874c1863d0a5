"""Per-session rules of the stream operators: small state, one step per row."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

from quillspan import constants as K


def dump(rule) -> str:
    return json.dumps(asdict(rule))


def load(kind: type, text: str | None):
    return kind(**json.loads(text)) if text else kind()


def loop_key(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.strip(K.WS_CHARS).lower()).strip()[:K.LOOP_LINE_CHARS]


@dataclass
class Loop:
    """Runs of equal complete lines."""

    buffer: str = ""
    last: str = ""
    streak: int = 0
    fired: bool = False

    def observe(self, delta: str) -> str | None:
        """The repeated line when the run becomes long enough, once."""
        if self.fired:
            return None
        *lines, self.buffer = (self.buffer + (delta or "")).split("\n")
        for norm in map(loop_key, lines):
            if len(norm) < K.LOOP_MIN_CHARS:
                continue
            self.streak = self.streak + 1 if norm == self.last else 1
            self.last = norm
            if self.streak >= K.LOOP_STREAK:
                self.fired = True
                return norm
        return None


#: (what is measured, least value, least characters of all notes): each alone is a repetition.
REPETITIONS = (("streak", 3, 500), ("dominant", 4, 900), ("narrow", 6, 900))
STALL_MS, STALL_CHARS, RECENT = 180_000, 4000, 8


@dataclass
class Stall:
    """Hidden notes before any visible answer.

    ``seen`` counts notes by a short digest and only up to the count that decides, so a note costs a few bytes.
    """

    chars: int = 0
    recent: list[str] = field(default_factory=list)
    seen: dict[str, int] = field(default_factory=dict)
    dominant: int = 0

    def measures(self) -> dict[str, int]:
        """Equal notes at the end, largest count of one note, and recent notes if they are no more than two kinds."""
        tail = next((k for k, note in enumerate(reversed(self.recent)) if note != self.recent[-1]), len(self.recent))
        return {"streak": tail, "dominant": self.dominant, "narrow": len(self.recent) if len(set(self.recent)) <= 2 else 0}

    def observe(self, note: str, elapsed_ms: int) -> str | None:
        text = (note or "").strip(K.WS_CHARS)
        if not text:
            return None
        self.chars += len(text)
        if key := loop_key(text):
            name = hashlib.md5(key.encode()).hexdigest()[:12]
            self.seen[name] = min(self.seen.get(name, 0) + 1, 4)
            self.dominant = max(self.dominant, self.seen[name])
            self.recent = [*self.recent, name][-RECENT:]
        found = self.measures()
        if any(found[what] >= least and self.chars >= chars for what, least, chars in REPETITIONS):
            return "repetition"
        return "stall" if elapsed_ms >= STALL_MS and self.chars >= STALL_CHARS else "none"


def _overlap(text: str, tag: str) -> int:
    """Length of the longest proper prefix of ``tag`` that ends ``text``."""
    return next((n for n in range(min(len(text), len(tag) - 1), 0, -1) if text.endswith(tag[:n])), 0)


#: Characters after which pending text is flushed.
VISIBLE_FLUSH, HIDDEN_FLUSH = 220, 140


def _full(text: str, most: int) -> bool:
    """Whether pending text is due: long enough, with a line end, or at the end of a sentence."""
    return len(text) >= most or "\n" in text or text.endswith((".", ":"))


def _strip(text: str) -> str:
    for literal in [*(t for pair in K.HIDDEN_TAGS for t in pair), K.END_TAG]:
        text = text.replace(literal, "")
    return text


@dataclass
class Split:
    """Hidden and visible text; tags may span deltas."""

    buffer: str = ""
    close: str = ""
    hidden: str = ""
    pending: str = ""
    thought: str = ""

    def observe(self, delta: str, done: bool = False, thought: str | None = None) -> list[tuple[str, str]]:
        """(kind, text) pieces ready after this delta; ``thought`` is hidden text that comes apart from it."""
        out: list[tuple[str, str]] = []
        self.thought += thought or ""
        if self.thought and (done or _full(self.thought, HIDDEN_FLUSH)):
            out.append(("thought", self.thought))
            self.thought = ""
        self.buffer += delta or ""
        while self.buffer:
            if self.close:
                at = self.buffer.find(self.close)
                take = at if at >= 0 else len(self.buffer) - (0 if done else _overlap(self.buffer, self.close))
                self.hidden += self.buffer[:take]
                self.buffer = self.buffer[take + (len(self.close) if at >= 0 else 0):]
                if at < 0:
                    break
                out += self._note()
                continue
            found = [(self.buffer.find(a), a, b) for a, b in K.HIDDEN_TAGS if a in self.buffer]
            if found:
                at, opening, closing = min(found, key=lambda f: f[0])
                self.pending += _strip(self.buffer[:at])
                self.buffer, self.close = self.buffer[at + len(opening):], closing
                continue
            keep = 0 if done else max(_overlap(self.buffer, tag) for tag in (*(a for a, _ in K.HIDDEN_TAGS), K.END_TAG))
            cut = len(self.buffer) - keep
            self.pending += _strip(self.buffer[:cut])
            self.buffer = self.buffer[cut:]
            break
        if done and self.close:
            out += self._note()
        if self.pending and (done or _full(self.pending, VISIBLE_FLUSH)):
            out.append(("visible", self.pending))
            self.pending = ""
        return out

    def _note(self) -> list[tuple[str, str]]:
        note, self.hidden, self.close = _strip(self.hidden).strip(K.WS_CHARS), "", ""
        return [("hidden", note)] if note else []


@dataclass
class Breaker:
    """Pause after repeated or permanent failures."""

    failures: int = 0
    paused_until: int = 0

    def observe(self, now_ms: int, ok: bool, message: str | None) -> bool:
        """Whether the call at ``now_ms`` is let through; its outcome counts only then."""
        if self.paused_until > now_ms:
            return False
        if ok:
            self.failures = self.paused_until = 0
            return True
        self.failures += 1
        permanent = any(p in (message or "").lower() for p in K.PERMANENT_FAILURES)
        if permanent or self.failures >= K.FAILURES_BEFORE_PAUSE:
            self.paused_until = now_ms + K.FAILURE_PAUSE_MS
        return True


@dataclass
class Ema:
    """Exponential average of positive samples."""

    value: float | None = None

    def observe(self, rate: float | None) -> None:
        if rate is not None and rate > 0:
            self.value = rate if self.value is None else K.EMA_WEIGHT * rate + (1 - K.EMA_WEIGHT) * self.value


#: The phase that an event opens; other events count as streamed content.
PHASES = {"start": "headers", "headers": "first_token"}


@dataclass
class Request:
    """One request at a time: its phase, its first and its last event in milliseconds."""

    phase: str = ""
    started: int = 0
    last: int = 0

    def deadline(self, limits: dict[str, int]) -> tuple[int, str] | None:
        """(time, limit) of what runs out first; a limit of 0 is none."""
        if not self.phase:
            return None
        dues = [(self.last + limits[self.phase], self.phase)] if limits[self.phase] else []
        dues += [(self.started + limits["total"], "total")] if limits.get("total") else []
        return min(dues, default=None)

    def expire(self, now: int, limits: dict[str, int]) -> list[tuple[int, int, str]]:
        """(start, end, outcome) of the request if a limit has run out before ``now``."""
        due = self.deadline(limits)
        if due is None or due[0] >= now:
            return []
        self.phase = ""
        return [(self.started, due[0], f"timeout:{due[1]}")]

    def observe(self, ts: int, event: str, limits: dict[str, int]) -> list[tuple[int, int, str]]:
        out = self.expire(ts, limits)
        if event == "start":
            self.phase, self.started, self.last = PHASES[event], ts, ts
        elif self.phase and event == "done":
            out.append((self.started, ts, "done"))
            self.phase = ""
        elif self.phase:
            self.phase, self.last = PHASES.get(event, "inactivity"), ts
        return out
