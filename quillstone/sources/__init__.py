"""Table sources."""

from quillstone.sources.tables import MemoryTable, ParquetTable, widened

__all__ = ["MemoryTable", "ParquetTable", "widened"]
