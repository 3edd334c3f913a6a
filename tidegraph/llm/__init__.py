"""Operations of a training-data pipeline over the tables documents, pages and benchmark.

Nothing else in the library imports this subpackage; its queries are in ``queries.py``.
"""
