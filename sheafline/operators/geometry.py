"""Words and lines of a page as plain values, for the few steps that need Python."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Word:
    text: str
    conf: float
    x0: float
    y0: float
    x1: float
    y1: float

    @property
    def height(self) -> float:
        return self.y1 - self.y0

    @property
    def mid(self) -> float:
        return (self.y0 + self.y1) / 2


@dataclass
class Row:
    words: list[Word] = field(default_factory=list)

    @property
    def text(self) -> str:
        return " ".join(w.text for w in self.words)

    @property
    def top(self) -> float:
        return min(w.y0 for w in self.words)

    @property
    def low(self) -> float:
        return max(w.y1 for w in self.words)
