"""Writers and table merges."""
