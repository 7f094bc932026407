"""Every demonstration query, gathered from the modules that register them."""

from inplay.plans import drives, evaluation, late_game, live, markets, modelling, normalization, sequences  # noqa: F401
from inplay.plans.registry import ORACLES, QUERIES  # noqa: F401
