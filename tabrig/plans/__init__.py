"""End-to-end jobs J1-J3."""

from .experiment import analyze_dataset, run_experiment_a, run_experiment_b

__all__ = ["analyze_dataset", "run_experiment_a", "run_experiment_b"]
