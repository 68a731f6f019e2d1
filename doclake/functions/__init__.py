"""Part of doclake."""
