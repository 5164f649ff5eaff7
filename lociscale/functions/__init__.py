"""Column builders: every scalar of the engine as an expression, none of them a Python UDF."""
