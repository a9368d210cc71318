"""Importing this module registers every query."""

from ratingspark.plans import q_statements  # noqa: F401
from ratingspark.plans import q_model  # noqa: F401
from ratingspark.plans import q_metrics  # noqa: F401
from ratingspark.plans import q_models  # noqa: F401
from ratingspark.plans import q_extra  # noqa: F401
from ratingspark.plans import q_resample  # noqa: F401
