"""DataFrame -> DataFrame operators of the pricing engine."""
