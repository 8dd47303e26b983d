"""The façade: partition a table under privacy models and generalise it."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.clustering import Clustering
from cloakframe.operators.models import DISTANCES, DistinctLDiversity, KAnonymity, PrivacyModel, TCloseness, check
from cloakframe.operators.mondrian import Mondrian
from cloakframe.operators.recoding import GlobalRecoding, Taxonomy
from cloakframe.operators.schemas import GeneralisedSchema, HumanReadable, MachineReadable, Microaggregation, RawData
from cloakframe.plans.roles import GROUP, RID, column_roles, with_row_id

STRATEGIES: dict[str, type[GeneralisedSchema]] = {
    "machine-readable": MachineReadable,
    "human-readable": HumanReadable,
    "microaggregation": Microaggregation,
    "raw": RawData,
    "global-recoding": GlobalRecoding,
}
ALGORITHMS = ("Mondrian", "MDAV-generic", "F-MDAV", "random-choice")


@runtime_checkable
class Partitioner(Protocol):
    """Anything that cuts a table into classes."""

    def partition(self, df: DataFrame) -> DataFrame:
        """(_rid, group_id) of a table with ``_rid``."""
        ...


class Anonymiser:
    """``anonymise()`` gives the release, ``partition()`` the classes."""

    def __init__(
        self,
        df: DataFrame,
        sensitive_column: str | None = None,
        feature_columns: Sequence[str] | None = None,
        generalisation_strategy: str | type[GeneralisedSchema] = "machine-readable",
        k: int = 1,
        l: int | None = None,  # noqa: E741
        t: float | None = None,
        diversity_definition: str = "distinct",
        closeness_metric: str = "max distance",
        algorithm: str | Partitioner = "Mondrian",
        categorical: Sequence[str] = (),
        taxonomies: Mapping[str, Taxonomy] | None = None,
        row_key: str | Sequence[str] | None = None,
        validate: bool = False,
    ) -> None:
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
        if not whole(k):
            raise TypeError("k is a whole number")
        if l is not None and not whole(l):
            raise TypeError("l is a whole number or None")
        if t is not None and not isinstance(t, float):
            raise TypeError("t is a float or None")
        own = not isinstance(algorithm, str) and isinstance(algorithm, Partitioner)  # strings have a method of that name
        if not isinstance(diversity_definition, str) or not (own or isinstance(algorithm, str)):
            raise TypeError("diversity_definition is a string, algorithm a string or has partition(df)")
        strategy = STRATEGIES.get(generalisation_strategy) if isinstance(generalisation_strategy, str) else generalisation_strategy
        if not (isinstance(strategy, type) and issubclass(strategy, GeneralisedSchema)):
            raise TypeError(f"unknown strategy: {generalisation_strategy}")
        if k < 1 or df.limit(k).count() < k:
            raise ValueError("k is at least 1 and at most the number of rows")
        if l is not None and l < 1:
            raise ValueError("l is at least 1")
        if t is not None and not 0 <= t <= 1:
            raise ValueError("t is within [0, 1]")
        if sensitive_column is not None and sensitive_column not in df.columns:
            raise ValueError(f"no such column: {sensitive_column}")
        if feature_columns is None:
            warnings.warn("all columns are features, the sensitive one too", stacklevel=2)
        features = tuple(feature_columns if feature_columns is not None else df.columns)
        roles = column_roles(df, features, categorical)
        if not own and algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm: {algorithm}")
        if (l is not None or t is not None) and sensitive_column is None:
            raise ValueError("l and t need a sensitive column")
        if not own and algorithm != "Mondrian" and (l is not None or t is not None):
            raise ValueError(f"{algorithm} gives k-anonymity only")
        models: list[PrivacyModel] = [KAnonymity(k)]
        if l is not None:
            if diversity_definition in ("simple", "entropy", "recursive"):
                raise NotImplementedError(diversity_definition)
            if diversity_definition != "distinct":
                raise ValueError(f"unknown definition: {diversity_definition}")
            models.append(DistinctLDiversity(l, sensitive_column))
        if t is not None:
            if closeness_metric not in DISTANCES:
                raise ValueError(f"unknown metric: {closeness_metric}")
            numeric = sensitive_column not in column_roles(df, [sensitive_column], categorical).categorical
            if closeness_metric.startswith("earth") and numeric:
                raise NotImplementedError("the earth mover's distance of a numeric column")
            models.append(TCloseness(t, sensitive_column, DISTANCES[closeness_metric]))
        self.models, self.features, self.algorithm, self.k = tuple(models), features, algorithm, k
        self.categorical, self.validate = tuple(categorical), validate
        self.data = df if RID in df.columns else with_row_id(df, row_key)
        extra = {"taxonomies": taxonomies} if strategy is GlobalRecoding else {}
        self.schema = strategy.create_for_data(self.data, features, categorical, **extra)
        self.roles = roles

    def partition(self) -> DataFrame:
        """(_rid, group_id).  A partitioner of one's own is trusted unless ``validate`` is set."""
        if not isinstance(self.algorithm, str):
            out = self.algorithm.partition(self.data)
        elif self.algorithm == "Mondrian":
            out = Mondrian(self.models, self.features, self.categorical).partition(self.data)
        else:
            name = {"MDAV-generic": "mdav", "F-MDAV": "fmdav", "random-choice": "random"}[self.algorithm]
            out = Clustering(self.k, self.features, name, self.categorical).partition(self.data)
        if self.validate and not check(self.data.join(out, RID), GROUP, list(self.models)).filter(~F.col("ok")).isEmpty():
            raise ValueError("the table as a whole does not meet the models")
        return out

    def anonymise(self) -> DataFrame:
        return self.schema.generalise(self.data, self.partition())
