"""See the package docstring of tallyweave."""
