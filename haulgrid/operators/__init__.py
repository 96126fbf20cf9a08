"""DataFrame operators: ``relational``, ``aggregates``, ``reshape``, ``ranking``, ``skew`` and ``spatial``."""
