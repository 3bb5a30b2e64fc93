"""Everything registered: importing this module fills the registry."""

from floodlens.plans import (damped_queries, data_queries, model_queries,
                             source_queries, stream_queries, window_queries)  # noqa: F401
from floodlens.plans.registry import ORACLES, QUERIES, forget  # noqa: F401
