"""Column builders: no UDFs, so everything stays in generated code."""
