"""Cleaning, profiling and summarizing messy tabular data as Spark DataFrame jobs."""

from scrubline.options import AGGRESSIVE, LARGE, PRESETS, SAFE, CleanOptions
from scrubline.plans.clean import Cleaned, clean
from scrubline.session import build_session

__all__ = [
    "AGGRESSIVE",
    "LARGE",
    "PRESETS",
    "SAFE",
    "CleanOptions",
    "Cleaned",
    "build_session",
    "clean",
]
