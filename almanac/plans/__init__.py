"""Jobs composed from the operators: feature frames, forecasts, model training, reports."""
