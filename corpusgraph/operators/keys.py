"""Shares of a budget of calls among the keys of a service.

A key serves a bounded number of calls at once and in all. Each task gets its own share, so tasks need no common state.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class KeyRing:
    """Keys in turn; one that is used up or refused is left out. ``names`` are never shown: a report counts, it doesn't list."""

    names: list[str]
    at_once: int = 3
    in_all: int = 300
    used: dict[int, int] = field(default_factory=dict)
    busy: dict[int, int] = field(default_factory=dict)
    refused: set[int] = field(default_factory=set)
    turn: int = 0

    def take(self) -> int | None:
        """The next key that may serve a call, by its place; None if none may now."""
        for step in range(len(self.names)):
            at = (self.turn + step) % len(self.names)
            if at not in self.refused and self.used.get(at, 0) < self.in_all and self.busy.get(at, 0) < self.at_once:
                self.used[at], self.busy[at] = self.used.get(at, 0) + 1, self.busy.get(at, 0) + 1
                self.turn = at + 1
                return at
        return None

    def give_back(self, at: int) -> None:
        self.busy[at] = max(0, self.busy.get(at, 0) - 1)

    def refuse(self, at: int) -> None:
        self.refused.add(at)

    def spent(self) -> bool:
        """Whether no key will ever serve again."""
        return all(at in self.refused or self.used.get(at, 0) >= self.in_all for at in range(len(self.names)))

    def refresh(self, names: list[str]) -> None:
        """Take up keys that were added; known ones keep their counts."""
        self.names += [n for n in names if n not in self.names]

    def report(self) -> dict[str, int]:
        return {"keys": len(self.names), "refused": len(self.refused), "calls": sum(self.used.values())}


def key_status(code: int | None) -> str:
    """What a probe of a key says: only a refusal for quota uses it up; no answer at all leaves it usable."""
    return "exhausted" if code == 429 else "available"
