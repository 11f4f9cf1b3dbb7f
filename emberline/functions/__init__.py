"""Column builders: no DataFrame, no action, only expressions."""
