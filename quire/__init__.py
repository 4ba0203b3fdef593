"""Document analytics on Spark: layout, text repair, structure, spans and chunks as DataFrame plans."""
