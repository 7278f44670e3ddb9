"""Training-data operators: one module for each of the ten, plus ``queries``.

Nothing outside this subpackage imports it.
"""
