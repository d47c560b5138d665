"""riskframe: Spark-native operators for tabular risk modelling.

Sub-packages
------------
sources    readers and writers (CSV/parquet loan tables, the ``loans`` fixture,
           training history, reports, metrics, model persistence)
functions  Column-expression builders (ratios, interactions, bins, maps, hashes)
operators  DataFrame operators: filters, encoders, exact sampling, profiling,
           compiled MLP scoring, training, evaluation metrics, Sobol analysis
plans      preset feature plans and the end-to-end jobs built from the operators
streaming  notes on stream use (the modelled workflow has no streaming stage)
"""

__version__ = "0.1.0"
