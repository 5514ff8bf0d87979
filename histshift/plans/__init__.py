"""User-level entry points: comparison run, daily job, snapshots, views."""
