"""Every report of the package, by name."""

from __future__ import annotations

import importlib

from packetloom.plans.registry import Report

MODULES = ("flow_reports", "dataset_reports", "packet_reports", "graph_reports", "score_reports", "path_reports", "label_reports", "quality_reports", "model_reports", "source_reports")


def reports() -> dict[str, Report]:
    found: dict[str, Report] = {}
    for module in MODULES:
        added = importlib.import_module(f"packetloom.plans.{module}").REPORTS
        clash = found.keys() & added.keys()
        if clash:
            raise ValueError(f"reports defined twice: {sorted(clash)}")
        found.update(added)
    return found
