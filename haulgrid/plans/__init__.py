"""End-to-end analyses: ``economy``, ``population``, ``highway``, ``rail`` and ``carriers``."""
