"""An analytics engine for timestamped events, as declarative Spark plans."""

from .engine import Engine, QueryResult
from .session import build_session
from .sources.catalog import TableConfig

__all__ = ["Engine", "QueryResult", "TableConfig", "build_session"]
