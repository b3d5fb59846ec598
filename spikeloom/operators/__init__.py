"""DataFrame operators: regressors, rates, likelihood sums and gradients."""
