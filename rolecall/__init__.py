"""Record aggregation on Spark: collect, clean, match, de-duplicate, score, rank."""

from rolecall.config import SearchConfig
from rolecall.session import build_session

__all__ = ["SearchConfig", "build_session"]
