"""All registered queries and their SQL."""

from __future__ import annotations

from tagweave.workload import assets, importing, manifests, overlays, replies, tagging, training

MODULES = (assets, manifests, tagging, replies, overlays, importing, training)
QUERIES = {name: function for module in MODULES for name, function in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
