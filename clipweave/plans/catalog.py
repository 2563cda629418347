"""The registered queries on the driver's tables and their SQL twins."""

from __future__ import annotations

from . import q_axes, q_boards, q_events, q_evidence, q_motion, q_scalars, q_semantic, q_sequence, q_world  # noqa: F401
from .registry import QUERIES, SQL, query  # noqa: F401
