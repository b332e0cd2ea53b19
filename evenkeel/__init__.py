"""Operators for hash-distributed tables, as Spark DataFrame plans.

``Cluster`` offers the operators by table name. The modules below
``evenkeel.operators`` and ``evenkeel.plans`` hold them as functions of
DataFrames, ``evenkeel.functions`` as columns and SQL functions.
"""

from evenkeel.cluster import Cluster
from evenkeel.operators.placement import Distribution
from evenkeel.sources import materialise, read_logs

__all__ = ["Cluster", "Distribution", "materialise", "read_logs"]
