"""Column-to-column building blocks: everything here is a Catalyst expression."""
