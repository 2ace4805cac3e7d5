"""Spark jobs for software-defect tables: profiling, cleaning, resampling, scoring, search."""
