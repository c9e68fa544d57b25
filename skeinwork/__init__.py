"""skeinwork: knowledge-graph and record analytics as Spark DataFrame operators."""
