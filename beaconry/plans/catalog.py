"""All registered queries; importing the query modules fills the registry."""

from beaconry.plans import (  # noqa: F401
    q_analytics,
    q_fleet,
    q_ingest,
    q_rollups,
    q_sources,
    q_streaming,
)
from beaconry.plans.registry import ENTRIES  # noqa: F401
