"""Named queries over the driver tables and their SQL twins."""

from plotwright.plans import identity, matching, readings, relational, streams, texts, web  # noqa: F401
from plotwright.plans.registry import ORACLES, QUERIES  # noqa: F401
