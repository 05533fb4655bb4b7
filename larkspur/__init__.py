"""larkspur: a relational analytics engine whose only executor is Spark.

Operators are functions from DataFrame to DataFrame; Catalyst plans them.
"""
