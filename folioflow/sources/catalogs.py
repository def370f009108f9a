"""YAML catalogs, parsed on the driver (they are configuration) and turned into small DataFrames."""

from __future__ import annotations

from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from folioflow.config import PolicyConfig

ENTITY_SCHEMA = "entity_id string, kind string, in_corpus boolean, label string, alias string, catalog_order int"
ZONE_SCHEMA = "version_id string, start_ordinal int, end_ordinal int, role string, reason string, expected_passage_count int"
VERSION_SCHEMA = "work_id string, version_id string, title string, profile string, is_canonical boolean, include_in_index boolean"
ROLES = ("authorial", "paratext", "mixed")


def load_yaml(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8-sig") as f:
        data = yaml.safe_load(f)
    if not isinstance(data, dict):
        raise ValueError(f"{path}: a mapping is expected")
    return data


def manifest_versions(spark: SparkSession, data: dict[str, Any]) -> DataFrame:
    """One row per version of a corpus manifest; a version id starts with its work id and occurs once."""
    rows = []
    for work, spec in data["works"].items():
        indexed = bool(spec.get("include_in_index", True))
        for version, canonical in [(spec["canonical_version"], True), *((v, False) for v in spec.get("reference_versions") or ())]:
            if not version.startswith(f"{work}."):
                raise ValueError(f"{version} doesn't belong to {work}")
            rows.append((work, version, spec.get("title_fa"), spec["profile"], canonical, indexed and canonical))
    if len({r[1] for r in rows}) < len(rows):
        raise ValueError("a version occurs twice")
    return spark.createDataFrame(rows, VERSION_SCHEMA)


def scope_entities(spark: SparkSession, data: dict[str, Any]) -> DataFrame:
    """One row per alias of every author and work in or out of the corpus."""
    rows = []
    for part, inside in (("in_corpus", True), ("known_out_of_corpus", False)):
        for kind in ("authors", "works"):
            for entity, spec in ((data.get(part) or {}).get(kind) or {}).items():
                names = list(dict.fromkeys([spec["label_fa"], *spec["aliases"]]))
                rows += [(entity, kind[:-1], inside, spec["label_fa"], alias, len(rows)) for alias in names]
    return spark.createDataFrame(rows, ENTITY_SCHEMA)


def paratext_zones(spark: SparkSession, data: dict[str, Any]) -> DataFrame:
    """One row per zone; zones of a version tile its ordinals from 1 to the expected count."""
    rows = []
    for version, spec in data["versions"].items():
        at, count = 1, int(spec["expected_passage_count"])
        for z in spec["zones"]:
            if z["start_ordinal"] != at or z["end_ordinal"] < at or z["role"] not in ROLES:
                raise ValueError(f"{version}: zone {z} doesn't follow")
            rows.append((version, at, int(z["end_ordinal"]), z["role"], z.get("reason"), count))
            at = int(z["end_ordinal"]) + 1
        if at != count + 1:
            raise ValueError(f"{version}: zones end before {count}")
    return spark.createDataFrame(rows, ZONE_SCHEMA)


def policy_config(data: dict[str, Any]) -> PolicyConfig:
    """Decision settings from a mapping of PolicyConfig's names; unknown ones are refused."""
    unknown = set(data) - set(PolicyConfig.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return PolicyConfig(**data)


def work_versions(versions: DataFrame, work: str) -> DataFrame:
    return versions.where(versions["work_id"] == work)


def canonical_versions(versions: DataFrame) -> DataFrame:
    return versions.where("is_canonical")


def reference_versions(versions: DataFrame) -> DataFrame:
    return versions.where("NOT is_canonical")


def indexable_versions(versions: DataFrame) -> DataFrame:
    return versions.where("is_canonical AND include_in_index")


def entities_of(entities: DataFrame, kind: str, in_corpus: bool = True) -> DataFrame:
    """entity_id and label of the authors or works inside or outside of the corpus, in catalog order."""
    rows = entities.where((entities["kind"] == kind) & (entities["in_corpus"] == in_corpus))
    return rows.groupBy("entity_id", "label").agg({"catalog_order": "min"}).orderBy("min(catalog_order)").select("entity_id", "label")


def entity(entities: DataFrame, entity_id: str) -> DataFrame:
    return entities.where(entities["entity_id"] == entity_id)


def expected_counts(zones: DataFrame) -> DataFrame:
    """version_id and expected_passage_count of the versions that have zones."""
    return zones.select("version_id", "expected_passage_count").distinct()
