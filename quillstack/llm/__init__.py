"""Training-data operators: one module per operator, plus ``queries`` for the registered queries and SQL."""
