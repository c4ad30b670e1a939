"""Observation catalogues, calibration matching and frame processing as Spark DataFrame plans."""
