"""Feature estimators, regressors, ensembles and model selection on Spark ML."""
