"""recordlens: audit, featurise, classify and evaluate labelled text records on Spark."""
