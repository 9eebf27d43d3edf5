"""End-to-end jobs: audit, baseline training, prediction, evaluation."""
