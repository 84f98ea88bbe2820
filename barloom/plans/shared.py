"""The shared folder, as the registered queries use it."""

from ..operators.shared import by_rows, shared_dir, written

__all__ = ["by_rows", "shared_dir", "written"]
