"""lawloom: discovery and evaluation of compact laws in revisable time series, on Spark DataFrames."""
