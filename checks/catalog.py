"""All registered queries."""

from . import q_address, q_graph, q_mixed, q_records, q_rib, q_stream, q_text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
