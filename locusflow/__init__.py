"""Reduced-representation sequencing analytics as Spark DataFrame plans."""
