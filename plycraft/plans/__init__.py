"""Stages: runs of operators with artifacts between them."""
