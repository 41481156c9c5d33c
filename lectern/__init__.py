"""Document preparation engine expressed as Spark DataFrame plans."""
