"""Spark-native multilinear and generalized linear models of binned event counts."""
