"""Expected results in SQL over the sample tables."""

from obsq_oracle.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL"]
