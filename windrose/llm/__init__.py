"""Training-data operators: one module per operator, each a function from DataFrame to DataFrame.

Nothing outside this subpackage imports it.
"""
