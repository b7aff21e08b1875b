"""Operators that prepare text corpora for language-model training.

Each module holds one operator with a general interface; ``queries`` derives the
registered digest queries from them. Nothing outside this package imports it.
"""
