"""filingweave: a PySpark-native engine for company-filing data."""
