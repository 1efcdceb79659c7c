"""Plans: from a configuration to a registered gazetteer."""
