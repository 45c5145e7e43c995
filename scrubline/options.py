"""Cleaning options and the three named presets."""

from __future__ import annotations

from dataclasses import dataclass, replace

PAD_MODES = ("pad", "truncate", "error")
FILL_MODES = ("none", "empty", "constant", "zero", "mean", "median", "mode")


@dataclass(frozen=True)
class CleanOptions:
    trim: bool = True
    drop_empty_rows: bool = True
    drop_duplicates: bool = False
    dedup_keys: tuple[str, ...] = ()
    pad_rows: str = "pad"
    remove_empty_columns: bool = False
    infer_types: bool = False
    parse_dates: bool = False
    date_format: str = "%Y-%m-%d"
    type_threshold: float = 0.9
    fill_missing: str = "none"
    fill_constant: str = ""
    na_tokens: tuple[str, ...] = ()
    delimiter: str | None = None
    #: with an optional key, a dedup key that is absent means "whole row"
    dedup_keys_optional: bool = False

    def __post_init__(self) -> None:
        if self.pad_rows not in PAD_MODES:
            raise ValueError(f"pad_rows must be one of {PAD_MODES}, not {self.pad_rows!r}")
        if self.fill_missing not in FILL_MODES:
            raise ValueError(f"fill_missing must be one of {FILL_MODES}, not {self.fill_missing!r}")

    @property
    def needs_profile(self) -> bool:
        return self.infer_types or self.parse_dates or self.fill_missing != "none"

    def but(self, **changes) -> CleanOptions:
        """A copy with some options changed."""
        return replace(self, **changes)


# In the presets type inference and date parsing go together.
SAFE = CleanOptions(infer_types=True, parse_dates=True)
AGGRESSIVE = SAFE.but(
    remove_empty_columns=True,
    drop_duplicates=True,
    dedup_keys=("id",),
    dedup_keys_optional=True,
    fill_missing="empty",
)
LARGE = CleanOptions()

PRESETS = {"safe": SAFE, "aggressive": AGGRESSIVE, "large": LARGE}
