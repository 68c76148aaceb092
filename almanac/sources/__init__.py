"""Reading observations and covariates; writing tables, metrics and history."""
