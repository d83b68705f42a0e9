"""Event-listing analytics as Spark jobs: ingest, consolidate, match, serve and recommend."""
