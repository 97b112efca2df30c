"""Every runnable query, with its checking SQL where SQL can express it."""

from .registry import ORACLES, QUERIES
from . import relational_queries  # noqa: F401
from . import mart_queries  # noqa: F401
from . import company_queries  # noqa: F401
from . import market_queries  # noqa: F401
from . import text_queries  # noqa: F401
from . import lifecycle_queries  # noqa: F401
from . import match_queries  # noqa: F401
