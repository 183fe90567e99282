"""Column functions: box, track and polygon geometry."""
