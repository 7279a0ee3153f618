"""All registered queries: name -> (function of session and folder, DuckDB SQL or None)."""

from __future__ import annotations

from .plans import evaluation, experiments, files, flagship, inference, modelling, structure, studies

REGISTRY: dict = {**flagship.QUERIES, **structure.QUERIES, **modelling.QUERIES, **inference.QUERIES, **experiments.QUERIES, **evaluation.QUERIES, **studies.QUERIES, **files.QUERIES}
REGISTRY |= inference.every_type(REGISTRY)
REGISTRY |= inference.full_reps(REGISTRY)
