"""See README for the layout of the package."""
