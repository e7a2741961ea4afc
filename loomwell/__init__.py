"""Loomwell: site-content analytics and training-data preparation as Spark DataFrame operators."""
