"""Training-data operators: one module an operator, registered in :mod:`tidemark.llm.registry`.

Nothing else in the library imports this subpackage.
"""
