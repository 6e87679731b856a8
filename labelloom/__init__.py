"""labelloom: Spark jobs for wide numeric tables with multilabel targets."""
