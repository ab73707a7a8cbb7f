"""Spark operators that judge sports-prediction models.

Every operator is a plain function from DataFrames to a DataFrame. See
``README.md`` for the tables, the operators and the scale notes.
"""

from roundledger.schemas import Tables
from roundledger.session import configure

__all__ = ["Tables", "configure"]
