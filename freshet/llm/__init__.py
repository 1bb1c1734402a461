"""Training-data operators: one module per operator, plus the query registry in ``queries``."""
