"""slotatlas: Spark-native operators for directory data.

Catalogs of places with prices, tags, addresses and weekly time slots:
extraction from page text, cleaning and data quality, reconciliation between
runs, faceted search and ranking, statistics and publish-ready facts.
"""
