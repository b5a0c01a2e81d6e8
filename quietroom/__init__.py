"""Multi-label text moderation analytics on Spark DataFrames."""

from quietroom.settings import DEFAULT_LABELS, DEFAULT_THRESHOLD, SEED, threshold_grid

__all__ = ["DEFAULT_LABELS", "DEFAULT_THRESHOLD", "SEED", "threshold_grid"]
