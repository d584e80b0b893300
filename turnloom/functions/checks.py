"""Argument checks, made when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class DistillationOptions:
    lmbda: float = 0.5
    beta: float = 0.5
    max_prompt_length: int = 512

    def __post_init__(self) -> None:
        for name in ("lmbda", "beta"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")
        if self.max_prompt_length <= 0:
            raise ValueError("max_prompt_length must be positive")


def check_model_length(n: int, least: int = 60) -> int:
    if n < least:
        raise ValueError(f"model_max_length must be at least {least}")
    return n


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Fails while the plan is made, not in a task."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
