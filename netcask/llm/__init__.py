"""Operations of a training-data pipeline, built on DataFrames.

Nothing else in the library imports this subpackage.
"""
