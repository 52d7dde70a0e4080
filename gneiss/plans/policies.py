"""Versioned rule sets: read from JSON, validated before any plan is built."""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass, field

CATEGORIES = ["Identity", "Structure", "Reactivity", "Property", "Biological", "Exposure", "Domain"]


@dataclass(frozen=True)
class Policy:
    version: str
    rules: dict = field(hash=False)


def _base(rules: dict, version: str = "rule_version") -> Policy:
    if rules.get("mode") != "review_only":
        raise ValueError("mode must be review_only")
    if not str(rules.get(version, "")).strip():
        raise ValueError(f"{version} is missing")
    return Policy(str(rules[version]), rules)


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def distance_policy(rules: dict) -> Policy:
    """Components with non-negative weights that sum to 1."""
    weights = [c.get("weight") for c in rules.get("distance_components") or [{}]]
    if any(not isinstance(w, (int, float)) or w < 0 for w in weights):
        raise ValueError("weights must be non-negative numbers")
    if not math.isclose(sum(weights), 1.0, abs_tol=1e-6):
        raise ValueError("weights must sum to 1")
    return _base(rules)


def class_policy(rules: dict) -> Policy:
    need = {"same_structural_type", "same_subclass", "same_functional_group", "same_parent_class", "same_corrected_class", "missing_class_information", "different_family"}
    if missing := need - set(rules.get("hierarchy_distance_weights", {})):
        raise ValueError(f"ladder lacks {sorted(missing)}")
    if not 0 <= rules.get("soft_layer_weight", -1) <= 1:
        raise ValueError("soft_layer_weight must be in [0, 1]")
    return _base(rules)


def layer_policy(rules: dict, columns: str) -> Policy:
    if not rules.get(columns):
        raise ValueError(f"{columns} must name columns")
    return _base(rules)


def domain_policy(rules: dict) -> Policy:
    if rules.get("descriptor_outlier_method") != "iqr_1.5":
        raise ValueError("the outlier method must be iqr_1.5")
    for k in ("minimum_nearest_neighbour_similarity", "scaffold_coverage_threshold"):
        if not 0 <= rules.get(k, -1) <= 1:
            raise ValueError(f"{k} must be in [0, 1]")
    if {rules.get("singleton_status"), rules.get("missing_structure_status")} - {"Inside", "Borderline", "Not assessable"}:
        raise ValueError("unknown status")
    return _base(rules)


def uncertainty_policy(rules: dict) -> Policy:
    if rules.get("categories") != CATEGORIES:
        raise ValueError("categories must be the seven, in order")
    if missing := [c for c in CATEGORIES if c.lower() not in rules]:
        raise ValueError(f"no block for {missing}")
    return _base(rules)


def all_or_none(loaders: dict[str, tuple]) -> dict[str, Policy | None]:
    """Policies by name; a layer whose rules are wrong is off (None) and breaks nothing else."""
    out = {}
    for name, (check, rules) in loaders.items():
        try:
            out[name] = check(rules)
        except (ValueError, KeyError, TypeError):
            out[name] = None
    return out


# What the other rule files must have.
VOCABULARIES = {"vocabulary_version", "endpoint_families", "results", "study_types", "species", "routes", "reliability", "evidence_statuses", "reviewer_statuses", "mapping_methods"}
HAZARD_SERVICE = {"rule_version", "base_url", "chemical_equal_path", "hazard_by_dtxsid_path", "source_version", "timeout_seconds", "max_retries", "min_request_interval_seconds", "cache_ttl_days", "allowed_identifier_columns"}
TAXONOMY_SERVICE = {"rule_version", "source", "base_url", "entity_path_template", "timeout_seconds", "cache_ttl_days", "min_request_interval_seconds", "allowed_identifier_columns", "required_output_fields", "status_version"}
NARRATIVE = {"matrix_version", "prompt_version", "max_source_text_length", "max_rendered_characters", "required_output_fields", "banned_claim_patterns", "endpoint_claim_terms"}


def _complete(rules: dict, need: set[str], version: str) -> Policy:
    if missing := need - set(rules):
        raise ValueError(f"missing: {sorted(missing)}")
    return Policy(str(rules[version]), rules)


def vocabularies(rules: dict) -> Policy:
    return _complete(rules, VOCABULARIES, "vocabulary_version")


def hazard_service(rules: dict) -> Policy:
    return _complete(rules, HAZARD_SERVICE, "rule_version")


def taxonomy_service(rules: dict) -> Policy:
    """Only the public structure key may be sent."""
    out = _complete(rules, TAXONOMY_SERVICE, "rule_version")
    if rules["allowed_identifier_columns"] != ["InChIKey"]:
        raise ValueError("only InChIKey may be sent")
    return out


def narrative(rules: dict) -> Policy:
    return _complete(rules, NARRATIVE, "matrix_version")


def ontology(path: str) -> Policy:
    """Approved mappings; none without a file."""
    if not os.path.exists(path):
        return Policy("unavailable", {"mappings": {}})
    rules = load(path)
    if not isinstance(rules.get("mappings"), dict):
        raise ValueError("mappings must be an object")
    return Policy(str(rules.get("ontology_mapping_version", "")), rules)


def classification(rules: dict) -> Policy:
    """The structural rules: their versions, positive whole thresholds, and a vocabulary of classes, each named once."""
    for name in ("rule_version", "taxonomy_dictionary_version"):
        if not str(rules.get(name, "")).strip():
            raise ValueError(f"{name} is missing")
    limits = rules.get("thresholds") or {}
    for name in ("polyether_min_ether_bridges", "macrocyclic_min_ring_size", "macrocyclic_min_ether_bridges"):
        if not isinstance(limits.get(name), int) or isinstance(limits.get(name), bool) or limits[name] < 1:
            raise ValueError(f"{name} must be a positive whole number")
    words = rules.get("primary_class_vocabulary") or []
    if not words or len(set(words)) < len(words):
        raise ValueError("primary_class_vocabulary must name each class once")
    return Policy(str(rules["rule_version"]), rules)


def ontology_mappings(rules: dict) -> dict[str, dict[str, str]]:
    """Rule id to (class_id, direct_parent, mapping_evidence) of approved mappings; a missing text is empty."""
    if not isinstance(rules.get("mappings"), dict):
        raise ValueError("mappings must be an object")
    return {i: {k: str(m.get(k, "")) for k in m} for i, m in rules["mappings"].items()}
