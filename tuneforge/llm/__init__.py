"""Operators of a training-data pipeline over the ``documents``, ``pages``, ``benchmark`` and
``labels`` tables. Nothing else in the library imports this subpackage."""
