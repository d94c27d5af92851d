"""Operators for large-scale training-data pipelines (near-dedup, classifiers, packing, mixing)."""
