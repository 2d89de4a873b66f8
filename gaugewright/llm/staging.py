"""The library's helpers for written tables, under the name that the operators here use."""

from ..sources.shared import forget, forget_new, fresh, new_path, shared_dir, tables, written

__all__ = ["forget", "forget_new", "fresh", "new_path", "shared_dir", "tables", "written"]
