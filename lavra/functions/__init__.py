"""See the package docstring of :mod:`lavra`."""
