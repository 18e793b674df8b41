"""Operators for building training corpora. Nothing else in cubeframe imports this subpackage."""
