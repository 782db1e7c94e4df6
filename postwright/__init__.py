"""Batch and micro-batch jobs on Spark for matching support mail to tickets."""
