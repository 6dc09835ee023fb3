"""Plans that put operators together: snapshots, scans, decisions."""
