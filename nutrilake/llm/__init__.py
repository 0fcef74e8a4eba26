"""Operators of a training-data pipeline over ``documents``, ``embeddings`` and ``pages``.

Nothing else in the library imports this subpackage. Each module holds one
operator; ``queries`` maps the query keys to them and ``textbytes`` has the
vectorised byte helpers that several of them share.
"""
