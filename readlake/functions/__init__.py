"""Part of readlake."""
