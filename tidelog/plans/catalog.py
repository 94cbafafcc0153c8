"""All queries of the engine with their SQL."""

from tidelog.plans import fleet, messages, state  # noqa: F401
from tidelog.plans.registry import QUERIES, SQL  # noqa: F401
