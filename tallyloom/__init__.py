"""Experiment analytics on Spark: labels, samples, scores, gates and simulations as DataFrame plans."""
