"""Connected components and joins of hot keys, as the library has them."""

from __future__ import annotations

from ..operators.components import components, hot_above, join_grouped  # noqa: F401
