"""Operators for preparing training corpora at scale.

Nothing else in the library imports this subpackage.  ``queries.py`` holds the
registered queries and ``sql.py`` the SQL they are compared with.
"""
