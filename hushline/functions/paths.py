"""Clip metadata parsed from relative paths, and the path-safety predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: dataset prefix in front of machine names in official score files.
DATASET_PREFIX = "DCASE2026T2"


def parts(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def stem_tokens(path: Column) -> Column:
    return F.split(F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", ""), "_")


def first_present(tokens: Column, *words: str) -> Column:
    """First of ``words`` that occurs among the lower-cased tokens, else 'unknown'."""
    lowered = F.transform(tokens, F.lower)
    out = F.when(F.array_contains(lowered, words[0]), words[0])
    for word in words[1:]:
        out = out.when(F.array_contains(lowered, word), word)
    return out.otherwise("unknown")


def condition(path: Column) -> Column:
    return first_present(stem_tokens(path), "anomaly", "normal")


def domain(path: Column) -> Column:
    return first_present(stem_tokens(path), "source", "target")


def machine_type(path: Column) -> Column:
    return F.element_at(parts(path), 1)


def section(path: Column) -> Column:
    tokens = stem_tokens(path)
    at = F.array_position(tokens, "section")
    found = (at > 0) & (at < F.size(tokens))
    return F.when(found, F.concat(F.lit("section_"), F.get(tokens, at.cast("int")))).otherwise("unknown")


def dataset_split(path: Column, release: str) -> Column:
    """Split label of a clip in the ``dev``, ``additional`` or ``evaluation`` release."""
    if release == "dev":
        return F.when(F.array_contains(parts(path), "test"), "dev_test").otherwise("dev_train")
    if release == "additional":
        return F.lit("add_train")
    if release == "evaluation":
        return F.lit("eval_test")
    raise ValueError(f"Unknown release: {release}")


def storage_key(value: Column) -> Column:
    return F.sha2(value, 256)


def strip_dataset_prefix(machine: Column) -> Column:
    return F.regexp_replace(machine, f"^{DATASET_PREFIX}", "")


def machine_category(machine: Column) -> Column:
    return F.when(machine.endswith("Emu"), "emulated").otherwise("real")


def unsafe(path: Column) -> Column:
    """Empty, '.', '..', absolute, or with any '..' part."""
    return path.isin("", ".", "..") | path.startswith("/") | F.array_contains(parts(path), "..")


def with_clip_metadata(df: DataFrame, path: str, release: str):
    """Add the metadata columns parsed from ``path``."""
    p = F.col(path)
    return df.select(
        "*",
        machine_type(p).alias("machine_type"),
        section(p).alias("section"),
        condition(p).alias("condition"),
        domain(p).alias("domain"),
        dataset_split(p, release).alias("dataset_split"),
    )
