"""Column builders: no data frames here, only expressions that Catalyst can fuse."""
