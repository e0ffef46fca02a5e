"""heatwise.sources."""
