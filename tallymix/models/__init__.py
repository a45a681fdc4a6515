"""Multinomial models with cluster-bootstrap intervals."""
