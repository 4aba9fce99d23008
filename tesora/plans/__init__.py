"""Queries over the shared star schema; importing the modules fills the registry."""

from tesora.plans import (  # noqa: F401
    budgeting,
    cashflow,
    codes,
    detection,
    fiscal,
    forecasting,
    identity,
    publishing,
    quality,
    streams,
)
from tesora.plans.registry import REGISTRY  # noqa: F401
