"""Column functions: identifiers, time grids and rolling statistics."""
