"""Query plans assembled from the operators."""
