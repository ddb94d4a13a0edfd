"""Entity mentions in text collections: preparation, vectors, search, clusters and co-occurrence on Spark."""

from spanloom.options import Options
from spanloom.session import get_session

__all__ = ["Options", "get_session"]
