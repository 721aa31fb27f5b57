"""Fixed table schemas and the required-column check used at every read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType()
}


def _struct(spec: str) -> T.StructType:
    """StructType from "name type, ..." (works before any session exists)."""
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


MANIFEST = _struct(
    "file_id string, relative_path string, machine_type string, section string, condition string, "
    "domain string, dataset_split string, sample_rate int, frames bigint, duration_seconds double, "
    "channels int, subtype string"
)
SCORES = _struct(
    "file_id string, machine_type string, section string, domain string, condition string, "
    "anomaly_score double, model_id string, experiment_id string"
)
OFFICIAL_SCORE = _struct("basename string, anomaly_score double")
SCORE_COLUMNS = SCORES.fieldNames()
IDENTITY = ["file_id", "machine_type", "section", "domain", "condition"]
GROUP = ["machine_type", "section"]

# Label vocabularies of the manifest.
CONDITIONS = ("normal", "anomaly", "unknown")
DOMAINS = ("source", "target", "unknown")
SPLITS = ("dev_train", "dev_test", "add_train", "eval_test")


class ContractError(ValueError):
    """A table does not meet the contract its reader requires."""


def require_columns(df: DataFrame, names: Iterable[str], label: str = "table") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"{label} is missing required columns: {', '.join(missing)}")
    return df
