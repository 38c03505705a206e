"""casebase: distributed case-based classification on Spark DataFrames."""

from .spec import FeatureSpec, to_cases
from .plans.model import CaseModel

__all__ = ["FeatureSpec", "to_cases", "CaseModel"]
