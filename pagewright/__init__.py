"""Document analytics on Spark: sources, layout, export, metrics and text operators."""
