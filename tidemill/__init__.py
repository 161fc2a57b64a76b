"""Tidemill: pipeline analytics and data reliability as Spark jobs."""
