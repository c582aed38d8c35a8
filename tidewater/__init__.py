"""Tidewater: DataFrame operators for event lakehouses and large text corpora on Spark."""
