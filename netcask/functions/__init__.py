"""Part of netcask."""
