"""Table schemas, table loading, JSON records and case artefacts."""
