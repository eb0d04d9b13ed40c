"""Training-data operators: thirteen components, their thin queries and the corpus pipeline's parts.

Nothing outside this package imports it; see ``queries.py`` for the registered queries.
"""
