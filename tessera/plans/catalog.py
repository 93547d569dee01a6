"""All registered queries and their SQL."""

from . import bindings, catalog_evaluation, catalog_files, catalog_models, catalog_stats  # noqa: F401

QUERIES, ORACLES = bindings.QUERIES, bindings.ORACLES
