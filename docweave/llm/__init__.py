"""Operators for preparing training data, one module each.

Outside this subpackage only ``scratch`` is imported, by ``docweave.streaming``.  ``registry`` holds the thin
``opN_*`` queries and the SQL they can be compared with.
"""
