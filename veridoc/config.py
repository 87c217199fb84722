"""Settings of an analysis, checked when made."""

from __future__ import annotations

from dataclasses import dataclass

SIGNATURE = 100
SHINGLE = 3
WINDOW = 5
MODES = ("openmp", "pthreads", "serial")


class ConfigError(ValueError):
    """A setting out of its bounds."""


@dataclass(frozen=True)
class Config:
    """threads and mode are kept for the report; Spark's master decides the parallelism."""

    input: str = ""
    corpus: str | None = None
    output: str = "./output"
    threads: int = 4
    sim_threshold: float = 0.75
    ai_threshold: float = 50.0
    bands: int = 20
    rows: int = 5
    ngram: int = 3
    mode: str = "openmp"
    benchmark: bool = False
    verbose: bool = False

    def __post_init__(self):
        for name in ("threads", "bands", "rows", "ngram"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= 1_000_000:
                raise ConfigError(f"{name} must be a whole number from 1 to 1000000")
        for name, most in (("sim_threshold", 1.0), ("ai_threshold", 1e6)):
            if not 0.0 <= getattr(self, name) <= most:
                raise ConfigError(f"{name} must lie from 0 to {most:g}")
        if self.mode not in MODES:
            raise ConfigError(f"mode must be one of {', '.join(MODES)}")

    @property
    def threads_used(self) -> int:
        return 1 if self.mode == "serial" else self.threads

    @property
    def order(self) -> int:
        return max(2, self.ngram)

    @property
    def banding(self) -> tuple[int, int]:
        """Bands and rows; more values than a signature has fall back to 20 by 5."""
        return (self.bands, self.rows) if self.bands * self.rows <= SIGNATURE else (20, 5)
