"""Training-data operators: one module per operator, shared helpers in ``workspace`` and ``wordhash``."""
