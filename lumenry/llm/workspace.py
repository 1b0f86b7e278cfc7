"""Where intermediate tables of an operator live: the shared folder of the session."""

from __future__ import annotations

from ..sources.scratch import cut_lineage as written
from ..sources.scratch import shared_dir, tidied

__all__ = ["shared_dir", "tidied", "written"]
