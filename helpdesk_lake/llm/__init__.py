"""Operators for preparing training corpora (de-duplication, filtering,
scoring, tokenisation, search). Nothing else in the library imports this
subpackage; ``queries`` holds the registered queries and their SQL."""
