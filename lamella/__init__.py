"""lamella: a Spark-native engine for columnar data: predicates, pruning, statistics, rewrites, variants and reports."""
