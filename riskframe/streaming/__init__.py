"""Streaming.

The modelled workflow has no streaming stage: every job reads a complete
table.  Nothing here adds stream operators.  What carries over unchanged is
that the per-row stages are stateless Column expressions - the feature
functions in :mod:`riskframe.functions`, fitted encoders' ``transform`` and the
compiled network of :mod:`riskframe.operators.scoring` - so they apply to a
``spark.readStream`` frame exactly as to a batch frame.  Fitting, sampling,
profiling and sensitivity analysis are whole-table jobs and stay batch-only.
"""
