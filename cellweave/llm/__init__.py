"""Training-data operators: one module per operator, nothing else in the library imports them.

Every module has a general DataFrame-in, DataFrame-out interface.  ``queries`` holds the
thin ``opN_<name>`` queries, ``oracles`` their SQL.
"""
