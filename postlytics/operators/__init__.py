"""DataFrame operators: roles, preprocessing, filters, EDA, tests, models."""

from postlytics.operators.roles import Roles, resolve_roles, clean_names, dedupe_names, detect_content_type
from postlytics.operators.features import Prepared, preprocess, meta_summary

__all__ = ["Roles", "resolve_roles", "clean_names", "dedupe_names", "detect_content_type",
           "Prepared", "preprocess", "meta_summary"]
