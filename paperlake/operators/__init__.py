"""DataFrame -> DataFrame operators over whole libraries."""
