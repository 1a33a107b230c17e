"""Landmark cohort studies on Spark: anchors, clocks, exposure, features, outcomes, weights, audits."""

__version__ = "0.1.0"
