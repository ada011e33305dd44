"""MLlib regressors, evaluation, importances and scoring."""
