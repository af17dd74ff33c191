"""Named queries, the store's lifecycle jobs and rollups."""
