"""vigil — model-reliability analytics on Spark.

Feature preparation, drift statistics, classifier evaluation, rolling
monitoring, job/registry tables, Spark ML champion/challenger training and
Structured Streaming, all as DataFrame -> DataFrame functions.
"""

__version__ = "0.1.0"
