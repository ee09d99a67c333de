"""sigspan: segment analytics on long sensor signals, built on Spark DataFrames, SQL and ML.

Modules: ``spec`` (pipeline constants), ``sources`` (tables, files, sinks, SQL views),
``operators`` (sequence, slices, profile, scaler, spectral, labels, model), ``functions``
(column expressions), ``plans`` (query catalogue, oracle SQL, staged flow) and ``streaming``
(incremental ingest of segment files).
"""

__version__ = "0.1.0"
