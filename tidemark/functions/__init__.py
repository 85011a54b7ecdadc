"""Part of tidemark; see the package docstring."""
