"""Version control for keyed tables, expressed as Spark DataFrame plans."""

from tidemark.schema import ColumnSpec, VersionedSchema
from tidemark.store import VersionStore

__all__ = ["ColumnSpec", "VersionedSchema", "VersionStore"]
