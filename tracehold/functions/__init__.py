"""The scalar library: Column expressions only, no Python runs per row."""
