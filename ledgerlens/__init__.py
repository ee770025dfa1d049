"""Evidence-first analytics over construction cost-estimate packages, expressed as Spark DataFrames."""
