"""Fingerprinting and profiling of large collections of files and text on Spark."""
