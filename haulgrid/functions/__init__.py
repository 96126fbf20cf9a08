"""Column expressions: ``nulls``, ``scalar`` and ``geometry``."""
