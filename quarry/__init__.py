"""quarry: Spark-native corpus, retrieval and model-ops operators.

Every public operator is a function DataFrame(s) -> DataFrame planned by
Catalyst; see README.md for the inventory.
"""

__version__ = "0.1.0"
