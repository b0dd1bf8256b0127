"""See the package docstring of fjordmill."""
