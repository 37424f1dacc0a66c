"""Functions that operators are put together from."""
