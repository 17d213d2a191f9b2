"""Parameters of the pricing job and of the read queries."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PricingParams:
    """Event-time settings. All durations are milliseconds."""

    window_ms: int = 5_000
    out_of_orderness_ms: int = 10_000
    lateness_ms: int = 10_000
    trigger_interval: str = "0 seconds"

    def __post_init__(self) -> None:
        if self.window_ms <= 0:
            raise ValueError("window_ms must be positive")
        if self.out_of_orderness_ms < 0 or self.lateness_ms < 0:
            raise ValueError("delays must not be negative")

    @property
    def retention_ms(self) -> int:
        """How far behind the newest event a row may be and still be counted."""
        return self.out_of_orderness_ms + self.lateness_ms


# Accepted zone ranges (inclusive).
READ_ZONES = (1, 16)
QUOTE_ZONES = (1, 64)

# List sizes of the read queries.
RECENT_WINDOWS = 100
AUDIT_RECORDS = 50
HISTORY_HOURS = 24
