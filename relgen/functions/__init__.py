"""Part of relgen."""
