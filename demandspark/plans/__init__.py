"""Whole jobs composed of operators: feature building, pricing, training."""
