"""Imports every plan module; each registers its queries."""

from fleetlens.plans import answers, commerce, fleet, library, retrieval, service, streams  # noqa: F401
from fleetlens.plans.registry import ORACLES, QUERIES  # noqa: F401
