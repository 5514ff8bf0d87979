"""DataFrame operators: profiles, bootstrap, RelDS, latest-wins, CDFs, statistics."""
