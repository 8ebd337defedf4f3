"""flowlens: network-flow detection analytics expressed as Spark DataFrame operators."""
