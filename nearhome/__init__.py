"""Hybrid recommendations over a marketplace of listings, users and interactions, as Spark jobs."""
