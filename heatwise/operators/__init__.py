"""heatwise.operators."""
