"""Signature scanning, scan analytics and table maintenance as Spark jobs."""
