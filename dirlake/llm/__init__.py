"""Training-data operators: ten distributed text, embedding and corpus operators.

Nothing outside this subpackage imports it, so it can be removed on its own.
"""
