"""Distances, diversity, subsampling, consolidation, ordination, stripes."""
