"""lakeloom: a Spark-native transactional lake engine.

Tables are plain files plus small JSON metadata; every relational step is a DataFrame plan.
"""

__version__ = "0.1.0"
