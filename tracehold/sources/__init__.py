"""What the engine reads and writes."""
