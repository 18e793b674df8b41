"""Byte-level reading and writing of containers; no Spark in here."""
