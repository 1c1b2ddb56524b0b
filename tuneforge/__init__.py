"""tuneforge: hyper-parameter search as Spark DataFrame jobs.

Search spaces and candidates are tables; data preparation, model fitting and
scoring are distributed aggregations batched over every candidate at once, so a
single pass over the training rows serves a whole batch of candidates.
"""

__version__ = "0.1.0"
