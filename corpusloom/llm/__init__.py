"""Training-data operators: one module each, with their queries in ``queries``.

Nothing else in the library imports this subpackage.
"""
