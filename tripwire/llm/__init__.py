"""Corpus-preparation operators for language-model training data.

Each module holds one operator; ``queries`` registers one query per operator.
Nothing else in the library imports this subpackage.
"""
