"""Operations of a training-data pipeline on documents, pages and vectors.

Nothing else in the library imports this subpackage.
"""
