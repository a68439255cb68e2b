"""Settings with their defaults and bounds."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import ClassVar


@dataclass(frozen=True)
class Settings:
    enabled: bool = True
    capture_mode: str = "auto"  # auto, explicit or off
    pii_mode: str = "redact"  # off, warn or redact
    card_bytes: int = 4096
    brief_bytes: int = 4096
    project_k: int = 12
    global_k: int = 8
    tail_chars: int = 20000
    min_turn_chars: int = 120
    interval_minutes: int = 30
    model_calls: int = 40
    model_deadline: float = 60.0
    model_seconds: float = 600.0

    BOUNDS: ClassVar[dict] = {"card_bytes": (256, 65536), "brief_bytes": (512, 65536), "project_k": (0, 50), "global_k": (0, 50), "tail_chars": (200, 200000), "min_turn_chars": (0, 10000), "interval_minutes": (1, 1440), "model_calls": (0, 1000)}

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name in self.BOUNDS:
                low, high = self.BOUNDS[f.name]
                if not low <= getattr(self, f.name) <= high:
                    raise ValueError(f"{f.name} must lie in {low}..{high}")
        if self.pii_mode not in ("off", "warn", "redact") or self.capture_mode not in ("auto", "explicit", "off"):
            raise ValueError("unknown mode")

