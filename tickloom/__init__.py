"""Order-book event analytics on Spark: binned features, graphs, linear models and robustness studies."""
