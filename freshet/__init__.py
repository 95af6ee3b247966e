"""freshet: evaluation of simulated time series against an observed record, on Spark."""
