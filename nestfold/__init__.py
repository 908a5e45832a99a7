"""nestfold: nested cross-validation analytics over feature cohorts, on Spark.

Every operator is a ``DataFrame -> DataFrame`` function keyed by columns such
as ``(repeat_id, fold_id, candidate_id)``, so that all folds run in one
distributed job.  See README.md for the layout.
"""
