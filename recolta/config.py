"""Result-affecting settings, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    """Settings of all time- and policy-dependent operators. as_of stands for the current time everywhere."""

    as_of: str = "2026-07-01 00:00:00"
    namespace: str = "default"
    hide_sensitive: bool = True
    diversity: bool = True
    diversity_factor: float = 0.3
    half_life_days: int = 90
    dedupe_hours: int = 2
    platform_dedupe_hours: dict[str, int] = field(default_factory=dict)
    near_dup_threshold: float = 0.82
    retention_days: int = 90
    low_score: float = 0.25
    context_chars: int = 4000

    def checked(self) -> EngineConfig:
        """Raises ValueError for settings outside their bounds."""
        if not 7 <= self.half_life_days <= 3650 or not 1 <= self.dedupe_hours <= 168:
            raise ValueError("half_life_days is 7 to 3650, dedupe_hours 1 to 168")
        return self
