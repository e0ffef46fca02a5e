"""heatwise.plans."""
