"""Projects and snapshots: reading, shapes, extraction, resolution."""
