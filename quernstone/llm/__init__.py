"""Training-data operators: dedup, language ID, search, chat, tokens, mixing.

Nothing else in the library imports this subpackage.  ``registry`` holds its
queries and their SQL.
"""
