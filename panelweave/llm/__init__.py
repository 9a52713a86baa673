"""Training-data operators: encoding, media columns, similarity joins, ledgers, models, archives.

Nothing outside this subpackage imports it.
"""
