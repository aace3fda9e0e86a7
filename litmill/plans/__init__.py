"""Whole stages of the pipeline, put together from the operators."""

from litmill.plans.stages import CleanConfig, clean, merge_sources, normalise

__all__ = ["CleanConfig", "clean", "merge_sources", "normalise"]
