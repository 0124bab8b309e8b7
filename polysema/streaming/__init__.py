"""Extras over streams; the batch operators don't need them."""
