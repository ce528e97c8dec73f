"""Registered queries over the driver's star schema."""

from tenderloom.plans import history_jobs, matrix_jobs, metric_jobs, model_jobs, selection_jobs, serving_jobs
from tenderloom.plans.registry import CHECKS, JOBS, runner

__all__ = ["CHECKS", "JOBS", "runner", "history_jobs", "matrix_jobs", "metric_jobs", "model_jobs", "selection_jobs", "serving_jobs"]
