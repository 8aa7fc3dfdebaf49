"""Column functions shared by users of the operators."""

from tidemark.operators.series import change, full, last, over, zscore
from tidemark.sources.files import epoch_ms

__all__ = ["change", "epoch_ms", "full", "last", "over", "zscore"]
