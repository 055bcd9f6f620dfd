"""Window definitions: rows or range, tumbling or sliding, and sessions."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class WindowSpec:
    measure: str
    size: int = 0
    slide: int = 0
    gap: int = 0

    def __post_init__(self):
        if self.measure not in ("rows", "range", "session"):
            raise ValueError(f"no window measure {self.measure!r}")
        if self.measure == "session":
            if self.gap <= 0:
                raise ValueError("a session needs a positive gap")
        elif self.size <= 0 or self.slide <= 0 or self.slide > self.size:
            raise ValueError("a window needs 0 < slide <= size")

    @staticmethod
    def rows(size: int, slide: int | None = None) -> WindowSpec:
        return WindowSpec("rows", size, size if slide is None else slide)

    @staticmethod
    def range(size: int, slide: int | None = None) -> WindowSpec:
        return WindowSpec("range", size, size if slide is None else slide)

    @staticmethod
    def session(gap: int) -> WindowSpec:
        return WindowSpec("session", gap=gap)

    @property
    def tumbling(self) -> bool:
        return self.measure != "session" and self.size == self.slide

    @property
    def pane(self) -> int:
        """Every window is a whole number of panes, and so is every slide."""
        return math.gcd(self.size, self.slide)

    @property
    def panes(self) -> int:
        return self.size // self.pane

    @property
    def panes_per_slide(self) -> int:
        return self.slide // self.pane

    @property
    def session_gap(self) -> str:
        """The gap as Spark takes it: Spark joins rows a whole gap apart, but a session ends there, so it is a microsecond less."""
        return f"{self.gap - 1} seconds 999999 microseconds"

    def describe(self) -> str:
        return f"session {self.gap}" if self.measure == "session" else f"{self.measure} {self.size}/{self.slide}"
