"""Nothing here: the matcher is a batch system and has no stream operators."""
