"""All queries of the market-data operators."""

from . import analysis, audit, evidence, indicators, ledgers, market, more, storage, strategy  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
