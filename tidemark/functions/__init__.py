"""Column expressions for risk and prices."""
