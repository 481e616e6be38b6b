"""Column-level building blocks: bins, UTC time, guarded arithmetic."""
