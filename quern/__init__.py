"""Spark-native operators for project knowledge, code graphs and event ledgers.

DataFrames in, DataFrames out.  `operators` holds the set-based operators,
`functions` the Column-level building blocks, `plans` the physical helpers
(skew handling, lineage cuts, id assignment), `sources` readers and writers and
`streaming` the incremental twins of the batch folds.
"""
