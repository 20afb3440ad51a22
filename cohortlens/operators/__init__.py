"""DataFrame operators (profile, clean, features, sequence, segments, stats)."""
