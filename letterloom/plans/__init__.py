"""Reports put together from several operators."""
