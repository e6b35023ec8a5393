"""Profiling, relationship discovery and quality scoring of undocumented tables on Spark."""

from .operators.relationships import ForeignKey
from .policy import DEFAULT_POLICY, QualityPolicy
from .session import build_session

__all__ = ["DEFAULT_POLICY", "ForeignKey", "QualityPolicy", "build_session"]
