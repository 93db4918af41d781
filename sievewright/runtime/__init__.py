"""What surrounds queries: settings, retries, rates, parallel calls, metrics, errors, lineage."""
