"""Structured Streaming jobs: the pricing job, the table job and their stores."""
