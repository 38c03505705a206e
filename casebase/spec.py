"""Feature specification of a case base.

A case base is an ordinary DataFrame with one key column, one label column and
a fixed, ordered list of features.  Categorical features are compared through
a learned value difference metric, numeric features through a scaled absolute
difference.  The order of ``features`` is the order in which distance terms are
summed, which keeps distances bit-identical across engines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeatureSpec:
    id: str
    label: str
    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    # summation order of the distance terms; default: categorical then numeric
    order: tuple[str, ...] | None = None
    # fixed spreads (feature -> sigma); features not listed are estimated
    sigma: dict = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "categorical", tuple(self.categorical))
        object.__setattr__(self, "numeric", tuple(self.numeric))
        if self.order is None:
            object.__setattr__(self, "order", self.categorical + self.numeric)
        else:
            object.__setattr__(self, "order", tuple(self.order))
        if set(self.order) != set(self.categorical) | set(self.numeric):
            raise ValueError("order must list every feature exactly once")
        if len(set(self.order)) != len(self.order):
            raise ValueError("duplicate feature in order")

    @property
    def features(self) -> tuple[str, ...]:
        return self.order

    def kind(self, f: str) -> str:
        return "cat" if f in self.categorical else "num"


def to_cases(df: DataFrame, spec: FeatureSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project a table onto the case layout ``(id, label, features..)``.

    Categorical values become strings (the metric only needs equality and a
    binary order); numeric values become doubles.  Selection is by name, so
    Catalyst prunes every other column at the scan.
    """
    cols = [F.col(c) for c in keep]
    cols.append(F.col(spec.id))
    cols.append(F.col(spec.label))
    for f in spec.order:
        if spec.kind(f) == "cat":
            cols.append(F.col(f).cast("string").alias(f))
        else:
            cols.append(F.col(f).cast("double").alias(f))
    return df.select(*cols)
