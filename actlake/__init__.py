"""Analytics over official administrative acts, as DataFrame and SQL plans."""
