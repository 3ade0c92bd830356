"""Code-corpus analytics as Spark jobs: snapshots in, relationship tables and answers out."""
