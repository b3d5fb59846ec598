"""Column functions: likelihoods, regressor bases and priors."""
