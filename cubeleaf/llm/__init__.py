"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage.  Every operator works on DataFrames, keeps memory
bounded by the size of a batch or a block, and cuts lineage (where it must) through Parquet in the shared
checkpoint folder.
"""
