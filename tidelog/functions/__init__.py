"""Scalar functions, the Bloom filter and operation metrics."""
