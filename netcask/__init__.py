"""Packet-stream analytics on Spark: packets are rows, processing steps are DataFrame transformations."""
