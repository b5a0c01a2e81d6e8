"""Parameters shared by all jobs."""

from __future__ import annotations

# The label set, seed, slice limits and sizes that results depend on.
DEFAULT_LABELS = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]
SEED = 42
DEFAULT_THRESHOLD = 0.5
SHORT_BELOW_WORDS = 20
LONG_ABOVE_WORDS = 100
MAX_FEATURES = 20_000
MAX_LEN = 128
BATCH_SIZE = 32
NOISE_LEVEL = 0.1
POS_WEIGHT_EPSILON = 1e-6
EXPLAIN_SAMPLES = 100
EXPLAIN_FEATURES = 10

# A side may be broadcast only when its row count is provably at or below this.
BROADCAST_ROWS = 200_000


def threshold_grid(start: float = 0.1, step: float = 0.05, count: int = 17) -> list[float]:
    """The searched thresholds, in the double arithmetic of a start/step range."""
    width = (start + step) - start
    return [start + i * width for i in range(count)]
