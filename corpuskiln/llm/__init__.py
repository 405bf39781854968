"""Training-data operators: one module per operator, ``registry`` holds their queries."""
